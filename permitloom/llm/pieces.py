"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut where no piece can reach across (before a run of spaces that
follows other text, and at newlines if no piece holds one).  The distinct chunks are put
one after another, and their suffixes sorted as far as the longest piece; a binary search
of every piece in that order gives the range of its occurrences.  Each occurrence is an
edge from its start to its end.  Edges are sorted by position and relaxed from left to
right: the label of a position is the last piece of the encoding of the text before it.

For the models of byte-pair kind, whose encoding is defined by merges and not by a sum of
scores, an edge (start, end, piece) relaxes its end exactly if the piece may follow the
label of its start: if merging the two pieces' joined text gives these two again.  A
boundary of an encoding is one that no merge ever crosses, and the merges on both sides
of it do not depend on anything beyond the next boundaries; so all neighbours of an
encoding pass that test, and a sequence of which all neighbours pass it is the encoding.
Just one edge per position passes, and the result equals the library's.

Null texts count as empty; an empty text has no ids and decodes to an empty text;
characters without a piece become byte pieces; a long text is encoded whole, in parts cut at
single spaces that no piece reaches across; an empty table gives an empty result; extra columns
stay as they are, but a column of the output's name is replaced; every row is encoded by
itself, so ties and repeats need no rule.  U+2581 in a text means a space, as in the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitloom.llm.common import PART_CHARS, apart, byte_slices, coded, give_back, list_parts, part_sums, ragged, string

SPACE = "▁"
#: Where a long text may be cut: at a space between two other characters, which each part's own leading space replaces.
BETWEEN = re.compile(f"(?<=[^ {SPACE}]) (?=[^ {SPACE}])")
CHUNKS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
#: Longer chunks are relaxed one by one, not side by side.
SIDE_BY_SIDE = 400
#: Characters of new chunks that are indexed together.
INDEX_CHARS = 250_000
#: Chunks, ids and pairs that a worker remembers; beyond any it starts anew with the next batch.
MEMO = 600_000
MEMO_IDS = 4_000_000
MEMO_PAIRS = 800_000


class Model:
    """Pieces of a model file: byte-pair kind, text as it is, byte pieces for the rest."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("a byte-pair model is needed that leaves text as it is, adds a leading space and has byte pieces")
        kinds = pb.ModelProto.SentencePiece
        if any(p.type in (kinds.UNUSED, kinds.USER_DEFINED) for p in proto.pieces):
            raise ValueError("unused and user-defined pieces are not supported")
        self.names = [p.piece for p in proto.pieces]
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.byte_id = np.zeros(256, np.int64)
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("no piece may hold a newline, or a space after other text")
        # What decoding writes for each id.
        kept = [b"" if p.type in (kinds.CONTROL, kinds.UNKNOWN) else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self.sizes = np.array([len(x) for x in kept], dtype=np.int64)
        self.data = np.frombuffer(b"".join(kept), np.uint8)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def merged(self, text: str) -> list[str]:
        """The symbols that the merges leave: best rank first, then leftmost."""
        symbols, rank = list(text), self.rank
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = rank.get(symbols[i] + symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of ragged ids; the leading space that encoding adds goes."""
        sizes = self.sizes[ids]
        data = self.data[ragged(self.begins[ids], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        raw = data.tobytes()
        return pa.array([raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], type=pa.string())


class Encoder:
    """Ids of texts; distinct chunks are encoded once."""

    def __init__(self, model: Model):
        self.model = model
        # Pieces that no merges lead to never stand in an encoding.
        reached = [p for p in model.ids if len(p) == 1 or model.merged(p) == [p]]
        self.alphabet = np.array(sorted({ord(c) for p in model.ids for c in p}), dtype=np.uint32)
        self.depth = max(map(len, reached))
        self.lengths = np.array([len(p) for p in reached], dtype=np.int64)
        self.piece_ids = np.array([model.ids[p] for p in reached], dtype=np.int64)
        # Class 0 ends a chunk, class 1 is any character that is in no piece.
        self.classes = np.zeros((len(reached), self.depth), np.int64)
        for i, p in enumerate(reached):
            self.classes[i, : len(p)] = 2 + np.searchsorted(self.alphabet, [ord(c) for c in p])
        self.single = np.zeros(len(self.alphabet) + 2, bool)
        self.single[self.classes[self.lengths == 1, 0]] = True
        self.base = len(model.names)
        self.foreign: dict[int, int] = {}
        self.foreign_chars: list[str] = []
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.new_pairs: dict[int, bool] = {}

    def suffixes(self, text: np.ndarray) -> np.ndarray:
        """Positions of the classes ``text`` (0 at its end) in order of what follows, ``depth`` deep."""
        rank, have = text.astype(np.int64), 1
        bits = int(rank.max()).bit_length() if len(rank) else 1
        order = None
        while have < self.depth or order is None:
            steps = max(2, 60 // max(1, bits))
            key = rank.copy()
            used = 1
            while used < steps and have * used < self.depth:
                ahead = np.zeros_like(rank)
                if have * used < len(rank):
                    ahead[: len(rank) - have * used] = rank[have * used :]
                key = (key << bits) | ahead
                used += 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = np.empty_like(new)
            rank[order] = new
            have, bits = have * used, max(1, int(new[-1]).bit_length())
        return order

    def ranges(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the range of ``order`` whose suffixes start with it, by binary search."""
        lo, hi = np.zeros(len(self.lengths), np.int64), np.full(len(self.lengths), len(order), np.int64)
        last = len(text) - 1
        for d in range(self.depth):
            on = np.nonzero((self.lengths > d) & (lo < hi))[0]
            if not len(on):
                break
            want = self.classes[on, d]
            bounds = []
            for above in (0, 1):
                a, b = lo[on].copy(), hi[on].copy()
                while (go := a < b).any():
                    mid = (a + b) >> 1
                    right = go & (text[np.minimum(order[np.minimum(mid, last)] + d, last)] < want + above)
                    a = np.where(right, mid + 1, a)
                    b = np.where(go & ~right, mid, b)
                bounds.append(a)
            lo[on], hi[on] = bounds
        return lo, hi

    def _follows(self, pair: int) -> bool:
        """Whether merging the texts of two pieces gives these pieces again."""
        ok = self.new_pairs.get(pair)
        if ok is None:
            at = int(np.searchsorted(self.pair_keys, pair))
            if at < len(self.pair_keys) and self.pair_keys[at] == pair:
                return bool(self.pair_ok[at])
            a, b = self._name(pair >> 32), self._name(pair & 0xFFFFFFFF)
            ok = self.new_pairs[pair] = self.model.merged(a + b) == [a, b]
        return ok

    def _settle(self) -> None:
        """Move the new pairs into the sorted arrays."""
        keys = np.concatenate([self.pair_keys, np.fromiter(self.new_pairs.keys(), np.int64, len(self.new_pairs))])
        ok = np.concatenate([self.pair_ok, np.fromiter(self.new_pairs.values(), bool, len(self.new_pairs))])
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ok = keys[order], ok[order]
        self.new_pairs = {}

    def _name(self, t: int) -> str:
        return self.model.names[t] if t < self.base else self.foreign_chars[t - self.base]

    def _allowed(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the one before it (-1: it starts a chunk)."""
        out = before < 0
        rest = np.nonzero(~out)[0]
        keys, back = np.unique(before[rest] << 32 | piece[rest], return_inverse=True)
        ok = np.zeros(len(keys), bool)
        if len(self.pair_keys):
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            known = self.pair_keys[at] == keys
            ok[known] = self.pair_ok[at[known]]
            missing = np.nonzero(~known)[0]
        else:
            missing = np.arange(len(keys))
        ok[missing] = [self._follows(k) for k in keys[missing].tolist()]
        out[rest] = ok[back]
        return out

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks by edges between positions, and the number of each chunk's."""
        joined = "\0".join(chunks) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(sizes + 1) - sizes - 1
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        text = np.where(self.alphabet[at] == points, at + 2, 1)
        text[starts + sizes] = 0
        order = self.suffixes(text)
        lo, hi = self.ranges(text, order)
        found = hi - lo
        begin = order[ragged(lo, found)].astype(np.int32)
        end = begin + np.repeat(self.lengths.astype(np.int32), found)
        piece = np.repeat(self.piece_ids, found)
        # A character without a piece of its own is an edge too; it becomes bytes later.
        odd = np.nonzero(~self.single[text] & (text > 0))[0]
        if len(odd):
            chars, back = np.unique(points[odd], return_inverse=True)
            for c in chars.tolist():
                if c not in self.foreign:
                    self.foreign[c] = self.base + len(self.foreign_chars)
                    self.foreign_chars.append(chr(c))
            begin, end = np.concatenate([begin, odd]), np.concatenate([end, odd + 1])
            piece = np.concatenate([piece, np.array([self.foreign[c] for c in chars.tolist()], dtype=np.int64)[back]])
        chunk = np.repeat(np.arange(len(chunks)), sizes + 1)
        depth = end - starts[chunk[begin]]
        long = sizes[chunk[begin]] > SIDE_BY_SIDE
        label, back_to = np.full(len(text) + 1, -1, np.int64), np.zeros(len(text) + 1, np.int64)
        # Sorted by position; of the edges to one position the longest comes first.
        sort = np.argsort(np.where(long, SIDE_BY_SIDE + end, depth) * (self.depth + 1) * 2 + (self.depth + begin - end), kind="stable")
        begin, end, piece, depth, long = begin[sort], end[sort], piece[sort], depth[sort], long[sort]
        n_short = int((~long).sum())
        cuts = np.searchsorted(depth[:n_short], np.arange(1, SIDE_BY_SIDE + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            e, s, p = end[a:b], begin[a:b], piece[a:b]
            while len(e):
                # One edge for each position: the longest that hasn't been tried.
                tried, first = np.unique(e, return_index=True)
                ok = self._allowed(label[s[first]], p[first])
                done = first[ok]
                label[e[done]], back_to[e[done]] = p[done], s[done]
                left = np.ones(len(e), bool)
                left[first] = False
                left &= label[e] < 0
                e, s, p = e[left], s[left], p[left]
        for s, e, p in zip(begin[n_short:].tolist(), end[n_short:].tolist(), piece[n_short:].tolist(), strict=True):
            if label[e] < 0:
                before = int(label[s])
                if before < 0 or self._follows(before << 32 | p):
                    label[e], back_to[e] = p, s
        # Back from the ends.
        lane, at = np.arange(len(chunks))[sizes > 0], (starts + sizes)[sizes > 0]
        places = []
        while len(at):
            places.append(at)
            at = back_to[at]
            on = at > starts[lane]
            lane, at = lane[on], at[on]
        place = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
        tokens, owner = label[place], chunk[place - 1]
        if (tokens < 0).any():
            raise AssertionError("a position without a label")
        if len(odd):
            extra = [self.model.byte_id[list(c.encode("utf-8", "surrogatepass"))] for c in self.foreign_chars]
            n = np.ones(len(tokens), np.int64)
            strange = np.nonzero(tokens >= self.base)[0]
            n[strange] = [len(extra[t]) for t in (tokens[strange] - self.base).tolist()]
            out = np.repeat(tokens, n)
            spots = ragged((np.cumsum(n) - n)[strange], n[strange])
            out[spots] = np.concatenate([extra[t] for t in (tokens[strange] - self.base).tolist()])
            tokens, owner = out, np.repeat(owner, n)
        return tokens.astype(np.int32), np.bincount(owner, minlength=len(chunks)).astype(np.int64)

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """Where the store has each of the distinct chunks; what it lacks is encoded."""
        at = pc.index_in(chunks, value_set=self.known)
        if at.null_count:
            lacking = chunks.filter(pc.is_null(at))
            names = lacking.to_pylist()
            ends = np.cumsum(np.fromiter(map(len, names), np.int64, len(names)))
            start = 0
            while start < len(names):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + INDEX_CHARS, side="right")))
                flat, sizes = self._encode(names[start:stop])
                self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
                self._settle()
                start = stop
            new = len(self.known) + np.cumsum(np.asarray(pc.is_null(at))) - 1
            self.known = pa.concat_arrays([self.known, lacking])
            at = pc.if_else(pc.is_null(at), pa.array(new), at.cast(pa.int64()))
        return np.asarray(at, dtype=np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's; long ones are encoded in parts."""
        texts, parts = apart(pc.fill_null(texts, ""), BETWEEN, PART_CHARS)
        if (parts > 1).any():
            each = [self._texts(texts.slice(k, 1)) for k in range(len(texts))]
            return np.concatenate([ids for ids, _ in each]), part_sums(np.concatenate([n for _, n in each]), parts)
        return self._texts(texts)

    def _texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > MEMO or len(self.flat) > MEMO_IDS or len(self.pair_keys) > MEMO_PAIRS:
            self._clear()
        uneven = np.asarray(pc.match_substring_regex(texts, f"  |{SPACE}|^ |^$|\\x00"), dtype=bool)
        lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~uneven)), "\n", " \n"), " ")
        offsets, words = list_parts(lists)
        codes, distinct = coded(words)
        units = pc.if_else(pc.starts_with(distinct, "\n"), distinct, pc.binary_join_element_wise(SPACE, distinct, ""))
        rest = [CHUNKS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts.filter(pa.array(uneven)).to_pylist()]
        more = {c: None for r in rest for c in r}
        if more:
            for c in units.to_pylist():
                more.pop(c, None)
            units = pa.concat_arrays([units, pa.array(list(more), pa.string())])
        index = {c: i for i, c in enumerate(units.to_pylist())} if rest else {}
        places = self._places(units)
        per_text = np.zeros(len(texts), np.int64)
        per_text[~uneven] = np.diff(offsets)
        per_text[uneven] = [len(r) for r in rest]
        rows = np.cumsum(per_text) - per_text
        order = np.empty(int(per_text.sum()), np.int64)
        order[ragged(rows[~uneven], per_text[~uneven])] = codes
        order[ragged(rows[uneven], per_text[uneven])] = [index[c] for r in rest for c in r]
        order = places[order]
        sizes = self.sizes[order]
        begins = (np.cumsum(self.sizes) - self.sizes)[order]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[ragged(begins, sizes)], sums[rows + per_text] - sums[rows]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(Model(path))


def _with(df: DataFrame, name: str, kind: str, source: str, make) -> DataFrame:
    """``df`` with the column ``name``, made from ``source`` by Arrow batches."""
    kept = [f for f in df.schema.fields if f.name != name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{name}` {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or make()
            for column, rows in step(batch, source):
                yield pa.RecordBatch.from_arrays([rows.column(f.name) for f in kept] + [column], names=[f.name for f in kept] + [name])

    same = source if source != name else f"__{source}"
    rows = df if same == source else df.withColumnRenamed(source, same)
    source = same
    return rows.select(*[F.col(f"`{f.name}`") for f in kept], *([F.col(f"`{source}`")] if source not in [f.name for f in kept] else [])).mapInArrow(run, schema)


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the array<int> column ``ids`` of each text."""

    def make():
        encoder = encoder_of(model_path)

        def step(batch, source):
            for part in byte_slices([batch], source, 3 << 20):
                flat, counts = encoder(string(part.column(source)))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), type=pa.int32())
                yield pa.ListArray.from_arrays(offsets, pa.array(flat, type=pa.int32())), part

        return step

    return _with(df, ids, "array<int>", text, make)


def encode_checked(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the struct column ``ids``: ids, and round_trip (they decode to the text, U+2581 as space), in one pass."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def make():
        encoder = encoder_of(model_path)

        def step(batch, source):
            for part in byte_slices([batch], source):
                texts = pc.fill_null(string(part.column(source)), "")
                flat, counts = encoder(texts)
                same = pc.equal(encoder.model.decode(flat, counts), pc.replace_substring(texts, SPACE, " "))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), type=pa.int32()), pa.array(flat, type=pa.int32()))
                yield pa.StructArray.from_arrays([lists, same], fields=list(kind)), part

        return step

    return _with(df, ids, "struct<ids:array<int>,round_trip:boolean>", text, make)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the string column ``text`` that the ids stand for (null ids: an empty text)."""

    def make():
        model = Model(model_path)

        def step(batch, source):
            for start in range(0, max(1, batch.num_rows), 1024):
                part = batch.slice(start, 1024)
                give_back()
                lists = part.column(source)
                counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
                yield model.decode(np.asarray(pc.list_flatten(lists), dtype=np.int64), counts), part

        return step

    return _with(df, text, "string", ids, make)

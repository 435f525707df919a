"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over consecutive words; a window's hash takes the words at the mask's
chosen positions only, so a substitution at the ignored one does not change it.  The hashes of
all benchmark windows are joined with those of all training windows, and at each hit the
item is laid along the document without gaps, its words against the document's, and judged:

* if ``WHOLE`` (80 %) of all the item's words agree there, all that agree are covered;
* else those that agree and lie in ``RUN`` (8) words in a row of which ``AGREE`` (7) agree.

A document is contaminated by an item if all such alignments cover at least min(13, 80 %)
different words of it.  An item of fewer than ``LEAST`` (5) words contaminates the documents that it is the whole of:
its words, and no others, looked up by a hash of them all.

The four masks miss none of these.  They find five words of which four agree, whichever
the fifth is.  An item of n words with 80 % in place differs in n // 5 at most, so of its n // 5
separate fives one differs in a word or none; and so does some five of any 8 words of which 7
agree.  With 10 words or more, either case makes two hits at least in one alignment.

A benchmark of up to ``BLOCK_BYTES`` of text is sent to all executors, and documents are read
once and never shuffled.  The windows of a larger one are a table: documents are read once
against a bit array of its hashes, of a fixed size, and what passes is joined with that table
by hash, dealt to ``SALTS`` tasks a hash; alignments with a second hit (or of items under 10
words) go on, and the texts of their documents are compared.  Both ways find the same.

Words are runs of letters and digits in lower case.  Null and empty texts, of items or
documents, hit nothing; a null key is kept in the result as null; repeated rows, of
documents or items, are reported each; of equally good alignments the first in the document is
reported; long texts are read whole, one at a time beyond 2 MB, with a bounded number of hits
at once; an empty table of either kind gives an empty result (and ``clean`` keeps all rows).
Extra columns are ignored, whatever their names (``clean`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitloom.llm.common import byte_slices, coded, forget, ragged, split_words, string, written
from permitloom.llm.minhash import word_hashes

#: Chosen positions of each mask.
MASKS = [(0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)]
LEAST, TWICE = 5, 10
RUN, AGREE = 8, 7
BLOCK_BYTES = 4 << 20
#: Bits of the array that documents are read against, as a power of two: 16 MB.
FILTER_BITS = 27
#: Tasks that the windows of one hash are dealt to.
SALTS = 16
#: Hits, and aligned words, that are held at once.
HITS, WORDS = 1 << 20, 1 << 21
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plain(texts: pa.Array) -> pa.Array:
    """Letters and digits in lower case with blanks between."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " ")


def plain_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets per text, and its words: runs of letters and digits in lower case."""
    return split_words(plain(texts))


def _whole(words: np.ndarray) -> np.ndarray:
    return -(-words * 4 // 5)


def _need(words: np.ndarray) -> np.ndarray:
    return np.minimum(13, _whole(words))


def _keys(ids: np.ndarray, at: np.ndarray, number: int) -> np.ndarray:
    """Hashes of the windows of a mask that start at ``at``."""
    h = np.full(len(at), _FACTORS[number], np.uint64)
    for k, o in enumerate(MASKS[number]):
        h = (h ^ ids[at + o]) * _FACTORS[32 + k]
        h ^= h >> np.uint64(29)
    return h


def _windows(ids: np.ndarray, rows: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of a mask begin (in one row each), and their hashes."""
    last = MASKS[number][-1]
    at = np.nonzero(rows[last:] == rows[: len(rows) - last])[0] if len(rows) > last else np.zeros(0, np.int64)
    return at, _keys(ids, at, number)


def _whole_keys(ids: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where texts of fewer words than an item is looked for in begin, and the hashes of all their words."""
    on = np.nonzero((n > 0) & (n < LEAST))[0]
    h = _FACTORS[48 + n[on]]
    for k in range(LEAST - 1):
        more = n[on] > k
        h[more] = (h[more] ^ ids[starts[on[more]] + k]) * _FACTORS[56 + k]
        h ^= h >> np.uint64(29)
    return starts[on], h


@dataclass
class Items:
    """Items as flat word numbers."""

    vocabulary: pa.Array
    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Items:
        offsets, words = plain_words(pa.array(texts, pa.string()))
        ids, vocabulary = coded(words)
        return Items(vocabulary, ids.astype(np.int64), offsets[:-1], np.diff(offsets))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The words' numbers; -1 for words that no item has."""
        return np.asarray(pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1), dtype=np.int64)


class Verdicts:
    """What alignments cover, of documents (rows) given as flat word numbers."""

    def __init__(self, items: Items, ids: np.ndarray, offsets: np.ndarray):
        self.items, self.ids, self.offsets = items, ids, offsets
        self.most = max(1, int(items.sizes.max(initial=1)))
        self.covered = np.zeros(0, np.int64)  # (pair, word of the item), pair = row and item in one number
        self.best = np.zeros((4, 0), np.int64)  # pair, words covered, length, first word in the document

    def add(self, row: np.ndarray, item: np.ndarray, lined: np.ndarray) -> None:
        """Judge alignments: item's first word at the flat place ``lined`` (which may lie before the row)."""
        n = self.items.sizes[item]
        a = np.maximum(0, self.offsets[row] - lined)
        length = np.minimum(n, self.offsets[row + 1] - lined) - a
        ends, start = np.cumsum(length), 0
        while start < len(row):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + WORDS, side="right")))
            cut = slice(start, stop)
            self._judge(row[cut], item[cut], lined[cut], a[cut], length[cut])
            start = stop

    def _judge(self, row: np.ndarray, item: np.ndarray, lined: np.ndarray, a: np.ndarray, length: np.ndarray) -> None:
        equal = self.ids[ragged(lined + a, length)] == self.items.ids[ragged(self.items.starts[item] + a, length)]
        begin = np.cumsum(length) - length
        whole = np.add.reduceat(equal, begin, dtype=np.int64) >= _whole(self.items.sizes[item])
        upto = np.concatenate([[0], np.cumsum(equal)])
        first = ragged(begin, np.maximum(0, length - RUN + 1))
        first = first[upto[first + RUN] - upto[first] >= AGREE]
        reach = np.zeros(len(equal) + 1, np.int64)
        np.add.at(reach, first, 1)
        np.add.at(reach, first + RUN, -1)
        on = np.nonzero(equal & ((np.cumsum(reach)[:-1] > 0) | np.repeat(whole, length)))[0]
        if not len(on):
            return
        of = np.searchsorted(begin, on, side="right") - 1
        pair = row[of] * len(self.items.sizes) + item[of]
        self.covered = np.unique(np.concatenate([self.covered, pair * self.most + on - begin[of] + a[of]]))
        heads = np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1])
        k, tails = of[heads], np.concatenate([heads[1:], [len(on)]])
        place = lined[k] + a[k] + on[heads] - begin[k] - self.offsets[row[k]]
        new = np.stack([pair[heads], tails - heads, on[tails - 1] - on[heads] + 1, place])
        best = np.concatenate([self.best, new], axis=1)
        best = best[:, np.lexsort((best[3], -best[1], best[0]))]
        self.best = best[:, np.concatenate([[True], np.diff(best[0]) > 0])]

    def found(self) -> list[tuple[int, int, int, int, int]]:
        """(row, item, words covered, length of the best alignment's cover, where it starts) of contaminated rows."""
        pair, words = np.unique(self.covered // self.most, return_counts=True)
        row, item = np.divmod(pair, max(1, len(self.items.sizes)))
        n = self.items.sizes[item]
        # A shorter item counts where it is the whole document.
        on = (words >= _need(n)) & ((n >= LEAST) | (n == self.offsets[row + 1] - self.offsets[row]))
        return list(zip(*(x[on].tolist() for x in (row, item, words, self.best[2], self.best[3])), strict=True))


@dataclass
class Block:
    """A benchmark of bounded size with its hashes, sorted, and each one's place in the flat words."""

    names: list
    items: Items
    keys: np.ndarray
    places: np.ndarray
    bits: np.ndarray
    shift: int
    short: dict

    @staticmethod
    def of(items: list[tuple[object, str]]) -> Block:
        found = Items.of([t for _, t in items])
        rows = np.repeat(np.where(found.sizes >= LEAST, np.arange(len(items)), -1 - np.arange(len(items))), found.sizes)
        windows = [_windows(found.ids.astype(np.uint64), rows, k) for k in range(len(MASKS))]
        at = np.concatenate([a[rows[a] >= 0] for a, _ in windows])
        keys = np.concatenate([h[rows[a] >= 0] for a, h in windows])
        order = np.argsort(keys, kind="stable")
        wide = min(26, max(16, (32 * len(keys)).bit_length()))
        seen = np.zeros(1 << wide, bool)
        seen[(keys >> np.uint64(64 - wide)).astype(np.int64)] = True
        short: dict[tuple[int, ...], list[int]] = {}
        for k in np.nonzero((found.sizes > 0) & (found.sizes < LEAST))[0].tolist():
            short.setdefault(tuple(found.ids[found.starts[k] : found.starts[k] + found.sizes[k]].tolist()), []).append(k)
        return Block([k for k, _ in items], found, keys[order], at[order], np.packbits(seen), 64 - wide, short)

    def overlaps(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, words covered, length of the best alignment's cover, where it starts) of contaminated rows."""
        offsets, words = plain_words(texts)
        ids = self.items.numbers(words)
        rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
        found = []
        for k, mask in enumerate(MASKS):
            on = np.ones(max(0, len(ids) - mask[-1]), bool)
            for o in mask:
                on &= ids[o : o + len(on)] >= 0
            at = np.nonzero(on)[0]
            at = at[rows[at] == rows[at + mask[-1]]]
            h = _keys(ids.astype(np.uint64), at, k)
            f = (h >> np.uint64(self.shift)).astype(np.int64)
            maybe = (self.bits[f >> 3] >> (7 - (f & 7)).astype(np.uint8)) & 1 > 0
            at, h = at[maybe], h[maybe]
            lo, hi = np.searchsorted(self.keys, h, side="left"), np.searchsorted(self.keys, h, side="right")
            found.append(np.stack([at, lo, hi - lo])[:, hi > lo])
        found = np.concatenate(found, axis=1)
        at, lo, n = found[:, np.argsort(found[0], kind="stable")]
        verdicts = Verdicts(self.items, ids, offsets)
        ends, start, wide = np.cumsum(n), 0, len(ids) + verdicts.most + 1
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HITS, side="right")))
            where, place = np.repeat(at[start:stop], n[start:stop]), self.places[ragged(lo[start:stop], n[start:stop])]
            item = np.searchsorted(self.items.starts, place, side="right") - 1
            lined = where - place + self.items.starts[item] + verdicts.most
            # Hits of one alignment are one.
            pair, lined = np.divmod(np.unique((rows[where] * len(self.items.sizes) + item) * wide + lined), wide)
            verdicts.add(*np.divmod(pair, len(self.items.sizes)), lined - verdicts.most)
            start = stop
        if self.short:
            n = np.diff(offsets)
            whole = [(r, k) for r in np.nonzero((n > 0) & (n < LEAST))[0].tolist() for k in self.short.get(tuple(ids[offsets[r] : offsets[r + 1]].tolist()), ())]
            r, k = np.array(whole, np.int64).reshape(-1, 2).T
            verdicts.add(r, k, offsets[r])
        return verdicts.found()


FOUND = "covered_words long, item_words long, longest long, start_word long"


def _small(benchmark: DataFrame, item_text: str) -> bool:
    return (benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0) <= BLOCK_BYTES


def _block(benchmark: DataFrame, item_key: str, item_text: str) -> Block:
    """The whole benchmark, whose size has been checked."""
    return Block.of([tuple(r) for r in benchmark.select(item_key, item_text).where(F.col(item_text).isNotNull()).collect()])


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the batch's texts, and the row of each."""
    offsets, hashes = word_hashes(plain(string(batch.column("text"))))
    return hashes, np.repeat(np.arange(batch.num_rows), np.diff(offsets))


def _bit_array(windows: DataFrame) -> np.ndarray:
    """A bit for each leading part of a hash, made in pieces of 16 kB by the executors."""
    low = 1 << 17

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bits in batch.column("bits"):
                seen = np.zeros(low, bool)
                seen[np.asarray(bits.values)] = True
                out.append(np.packbits(seen).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(out, pa.binary())], names=["piece", "bits"])

    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    pieces = windows.select(bit.alias("bit")).distinct().groupBy(F.shiftright("bit", 17).alias("piece")).agg(F.collect_list(F.col("bit").bitwiseAND(low - 1)).alias("bits"))
    whole = np.zeros((1 << FILTER_BITS) // low * (low // 8), np.uint8).reshape(-1, low // 8)
    for r in pieces.mapInArrow(run, "piece long, bits binary").toLocalIterator():
        whole[r.piece] = np.frombuffer(r.bits, np.uint8)
    return whole.ravel()


def _joined(texts: DataFrame, benchmark: DataFrame, item_key: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """For a benchmark of any size: m1, m2, item and what was found; and item, name of all items.

    texts: m1, m2 (two hashes that stand for the text), text.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 33
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(item, item + batch.num_rows)), *batch.columns], names=["item", "name", "text"])
            item += batch.num_rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            hashes, rows = _rows_of(batch)
            n = np.bincount(rows, minlength=batch.num_rows)
            starts, names = np.cumsum(n) - n, np.asarray(batch.column("item"))
            for k in range(len(MASKS)):
                at, h = _windows(hashes, rows, k)
                at, h = at[n[rows[at]] >= LEAST], h[n[rows[at]] >= LEAST]
                if k == 0:
                    at, h = (np.concatenate(x) for x in zip((at, h), _whole_keys(hashes, starts, n), strict=True))
                r = rows[at]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(names[r]), pa.array(at - starts[r]), pa.array(n[r])], names=["h", "item", "place", "words"])

    kind = benchmark.schema[item_key].dataType.simpleString()
    named = benchmark.select(F.col(item_key).alias("name"), F.col(item_text).alias("text")).where("text is not null")
    numbered = written(named.mapInArrow(number, f"item long, name {kind}, text string"), "items")
    windows = written(numbered.select("item", "text").mapInArrow(cut, "h long, item long, place long, words long"), "windows")
    bits = texts.sparkSession.sparkContext.broadcast(_bit_array(windows))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            hashes, rows = _rows_of(batch)
            n = np.bincount(rows, minlength=batch.num_rows)
            starts = np.cumsum(n) - n
            for k in range(len(MASKS)):
                at, h = _windows(hashes, rows, k)
                if k == 0:
                    at, h = (np.concatenate(x) for x in zip((at, h), _whole_keys(hashes, starts, n), strict=True))
                f = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                maybe = (bits.value[f >> 3] >> (7 - (f & 7)).astype(np.uint8)) & 1 > 0
                at, h = at[maybe], h[maybe]
                r = pa.array(rows[at])
                yield pa.RecordBatch.from_arrays([batch.column("m1").take(r), batch.column("m2").take(r), pa.array(h.view(np.int64)), pa.array(at - starts[rows[at]])], names=["m1", "m2", "h", "at"])

    hits = texts.mapInArrow(pick, "m1 long, m2 long, h long, at long").withColumn("salt", F.pmod("m1", F.lit(SALTS)).cast("int"))
    salted = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lined = hits.join(salted, ["h", "salt"]).groupBy("m1", "m2", "item", (F.col("at") - F.col("place")).alias("lined")).agg(F.count("*").alias("n"), F.max("words").alias("words"))
    pairs = written(lined.where(f"n > 1 or words < {TWICE}").groupBy("m1", "m2", "item").agg(F.collect_list("lined").alias("lined")), "pairs")
    # A text once for all its copies, before the items that it is held against.
    wanted = texts.join(pairs.select("m1", "m2").distinct(), ["m1", "m2"], "left_semi").groupBy("m1", "m2").agg(F.first("text").alias("text"))
    heads = wanted.select("m1", "m2", F.lit(None).cast("long").alias("item"), "text", F.array().cast("array<long>").alias("lined"))
    rows = heads.unionByName(pairs.join(numbered.select("item", "text"), "item").select("m1", "m2", "item", "text", "lined"))
    rows = rows.repartition("m1", "m2").sortWithinPartitions("m1", "m2", F.col("item").asc_nulls_first())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, text = None, None
        for batch in byte_slices(batches, "text"):
            m1, m2, items = (batch.column(c).to_pylist() for c in ("m1", "m2", "item"))
            heads = [k for k, item in enumerate(items) if item is None]
            for s, e in zip([0, *heads], [*heads, len(items)], strict=True):
                if s < e and items[s] is None:
                    doc, text, s = (m1[s], m2[s]), string(batch.column("text").slice(s, 1)), s + 1  # noqa: PLW2901
                if s == e:
                    continue
                block = Items.of(string(batch.column("text")).slice(s, e - s).to_pylist())
                offsets, words = plain_words(text)
                verdicts = Verdicts(block, block.numbers(words), offsets)
                lists = batch.column("lined").slice(s, e - s)
                lined = np.asarray(lists.flatten(), dtype=np.int64)
                item = np.repeat(np.arange(e - s), np.asarray(pc.list_value_length(lists)))
                verdicts.add(np.zeros(len(lined), np.int64), item, lined)
                found = verdicts.found()
                if found:
                    _, i, c, n, at = zip(*found, strict=True)
                    one = lambda x: pa.array([x] * len(i))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([one(doc[0]), one(doc[1]), pa.array([items[s + k] for k in i]), pa.array(c), pa.array(block.sizes[list(i)]), pa.array(n), pa.array(at)], names=["m1", "m2", "item", "covered_words", "item_words", "longest", "start_word"])

    found = written(rows.mapInArrow(judge, f"m1 long, m2 long, item long, {FOUND}"), "found")
    forget(windows, pairs)
    return found, numbered.select("item", "name")


def _marked(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.xxhash64(text).alias("m1"), F.xxhash64(F.lit(7), text).alias("m2"), F.col(text).alias("text")).where("text is not null")


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """A row per contaminated document and item: ``key``, ``item_key``, covered_words, item_words, longest, start_word."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind, item_kind = rows.schema["key"].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    if not _small(benchmark, item_text):
        found, names = _joined(_marked(rows, "text"), benchmark, item_key, item_text)
        marked = rows.select("key", F.xxhash64("text").alias("m1"), F.xxhash64(F.lit(7), "text").alias("m2"))
        out = marked.join(found, ["m1", "m2"]).join(names, "item")
        return out.select(F.col("key").alias(key), F.col("name").alias(item_key), "covered_words", "item_words", "longest", "start_word")
    sent = df.sparkSession.sparkContext.broadcast(_block(benchmark, item_key, item_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in byte_slices(batches, "text"):
            found = block.overlaps(string(batch.column("text")))
            if found:
                r, i, c, n, at = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(r)), pa.array([block.names[k] for k in i]), pa.array(c), pa.array(block.items.sizes[list(i)]), pa.array(n), pa.array(at)], names=["key", "item", "covered_words", "item_words", "longest", "start_word"])

    out = rows.mapInArrow(run, f"key {kind}, item {item_kind}, {FOUND}")
    return out.withColumnRenamed("key", key).withColumnRenamed("item", item_key)


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of ``df`` that no item contaminates, with all their columns."""
    if not _small(benchmark, item_text):
        bad = _joined(_marked(df, text), benchmark, item_key, item_text)[0].select(F.col("m1").alias("__m1"), F.col("m2").alias("__m2")).distinct()
        same = (F.xxhash64(text) == F.col("__m1")) & (F.xxhash64(F.lit(7), text) == F.col("__m2"))
        return df.join(bad, same, "left_anti")
    sent = df.sparkSession.sparkContext.broadcast(_block(benchmark, item_key, item_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text):
            bad = {x[0] for x in sent.value.overlaps(string(batch.column(text)))}
            yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_())) if bad else batch

    return df.mapInArrow(run, df.schema)

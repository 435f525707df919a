"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled texts.  A
text is parsed against it greedily: the next phrase is the longest prefix of what is left
that occurs in the sample (one letter, if it occurs nowhere).  With c phrases over n
symbols and a sample of N symbols, c * log2(N) / n estimates the cross entropy in bits per
symbol; the language with the least wins (ties: the first in order of name).

Texts are lower-cased, and each run of characters that are no letters is one blank.  They
are parsed in pieces of ``PIECE`` symbols, all pieces of a batch side by side, as if each began a
phrase.  Then each piece is entered again with the phrase that its predecessor left open, and
followed until both parses begin a phrase at one place, after which they are the same; where
that doesn't happen the next piece is entered again too.  So the count is that of the parse of
the whole text.  A text of over ``PART_CHARS`` characters goes through in parts, each
beginning with the state that the last one left.

Automata are one table, in which states with few ways on fill the gaps of others, with room for twice its entries
or more, so its size follows from the samples' symbols and not from the alphabet.

Training takes for each language up to ``SAMPLE_TEXTS`` different texts in order of a hash of
the text (those of 200 to 8,000 characters first), and of these up to ``SAMPLE_SYMBOLS`` symbols; that
is what the driver gathers and all executors get, for each language in the data.
Rows with a null language or text teach nothing.  Of the rows to predict only the text is
used.  A text that is null or has no letter is ``und`` with score 0; so is every text if
nothing was learned, as from an empty table.  An empty table to predict gives an empty result.
Repeated rows are predicted each; columns of the output's names are replaced, others are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permitloom.llm.common import PART_CHARS, byte_slices, out_batch, string

SAMPLE_TEXTS = 100
SAMPLE_SYMBOLS = 40_000
PIECE = 1024
#: Shares that a language is dealt to for its sample.
SHARES = 64
BLANK = 0


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and s not in step[at]:
            step[at][s] = new
            at = link[at]
        if at >= 0:
            to = step[at][s]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and step[at].get(s) == to:
                    step[at][s] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return step


class Steps:
    """A hash table from (state, symbol) to the next state, asked for many at once, by any keys; languages use ``Placed``.

    An entry is one number of key and value, so a look takes one access; where they don't fit (hundreds
    of languages), values are in an array of their own.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.low = int(values.max(initial=1)).bit_length()
        self.apart = None
        if int(keys.max(initial=1)).bit_length() + self.low > 63:
            self.apart, self.low, values, own = np.zeros(1 << bits, values.dtype), 0, 0, values
        self.entries = np.full(1 << bits, -1, np.int64)
        todo, slot, entries = np.arange(len(keys)), self._slot(keys), (keys << self.low) | values
        while len(todo):
            free = self.entries[slot[todo]] < 0
            self.entries[slot[todo[free]]] = entries[todo[free]]  # of several, one stays
            todo = todo[self.entries[slot[todo]] != entries[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask
        if self.apart is not None:
            self.apart[slot] = own

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 where there is none."""
        shape, keys = keys.shape, keys.ravel()
        slot = self._slot(keys)
        out = self.entries[slot]
        rest = np.nonzero(((out >> self.low) != keys) & (out >= 0))[0]
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            have = self.entries[slot[rest]]
            out[rest] = have
            rest = rest[((have >> self.low) != keys[rest]) & (have >= 0)]
        value = out & ((1 << self.low) - 1) if self.apart is None else self.apart[slot]
        return np.where(out < 0, -1, value).reshape(shape)


class Placed:
    """The next state of (state, symbol), asked for many at once.

    A state is known by its place in one table: its way by a symbol is the entry so many places
    further, which names the state that it belongs to, so a look takes one access.  Places are
    chosen at random, for states with many ways first, until no entry is taken twice.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, width: int, states: int):
        state, symbol = keys // width, keys % width
        order = np.argsort(state, kind="stable")
        state, symbol, values = state[order], symbol[order], values[order]
        ways = np.bincount(state, minlength=states)
        begin = np.cumsum(ways) - ways
        random, size = np.random.default_rng(0), 1 << int(2 * max(len(keys), states) + 8).bit_length()
        while (place := self._places(ways, begin, symbol, size, width, random)) is None:
            size *= 2
        #: Where each state is, by its number in the keys.
        self.place, self.low = place, int(size).bit_length()
        self.mask = (1 << self.low) - 1
        self.entries = np.full(size + width, -1, np.int64)
        self.entries[place[state] + symbol] = (place[state] << self.low) | place[values]

    @staticmethod
    def _places(ways: np.ndarray, begin: np.ndarray, symbol: np.ndarray, size: int, width: int, random: np.random.Generator) -> np.ndarray | None:
        """Places without a clash; none if they are not found in some rounds."""
        place, named, taken = np.full(len(ways), -1), np.zeros(size, bool), np.zeros(size + width, bool)
        for n in np.unique(ways)[::-1].tolist():
            todo = np.nonzero(ways == n)[0]
            of = symbol[begin[todo][:, None] + np.arange(n)]
            for _ in range(1000):
                if not len(todo):
                    break
                at = random.integers(0, size, len(todo))
                _, nth, clash = np.unique(at, return_index=True, return_inverse=True)
                good = (nth[clash] == np.arange(len(todo))) & ~named[at]
                slots = at[:, None] + of
                good &= ~taken[slots].any(1)
                # Of those that want one entry, the first takes it.
                mine = slots[good].ravel()
                _, nth, clash = np.unique(mine, return_index=True, return_inverse=True)
                good[good] = (nth[clash] == np.arange(len(mine))).reshape(int(good.sum()), n).all(1)
                place[todo[good]], named[at[good]], taken[slots[good]] = at[good], True, True
                todo, of = todo[~good], of[~good]
            if len(todo):
                return None
        return place


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts with 0 for non-letters, and the number of each text's."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    sizes = np.asarray(pc.utf8_length(lower), dtype=np.int64)
    points = np.frombuffer("".join(lower.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int32), sizes
    present = np.nonzero(np.bincount(points))[0]
    keep = np.zeros(int(present[-1]) + 1, bool)
    keep[present] = [chr(c).isalpha() for c in present.tolist()]
    return np.where(keep[points], points, 0).astype(np.int32), sizes


def squeezed(symbols: np.ndarray, sizes: np.ndarray, begun: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each run of blanks as one; none at a text's start (that has not ``begun`` before with a letter)."""
    first = np.zeros(len(symbols) + 1, bool)
    first[np.cumsum(sizes) - sizes] = not begun
    blank = symbols == BLANK
    drop = blank & (first[:-1] | np.concatenate([[False], blank[:-1]]))
    kept = np.concatenate([[0], np.cumsum(~drop)])
    ends = np.cumsum(sizes)
    return symbols[~drop], kept[ends] - kept[ends - sizes]


@dataclass
class Languages:
    """The automata of all languages over one alphabet, in one table."""

    names: list[str]
    alphabet: np.ndarray
    steps: Placed
    #: The first state of each language, and where each symbol leads from there.
    roots: np.ndarray
    first: np.ndarray
    bits: np.ndarray

    @staticmethod
    def learn(samples: dict[str, list[str]], limit: int = SAMPLE_SYMBOLS) -> Languages:
        """From the sample texts of each language; texts are never joined into one phrase."""
        points = {}
        for name in sorted(samples):
            symbols, sizes = squeezed(*letters(pa.array(samples[name], pa.string())))
            parts, used = [], 0
            for x in np.split(symbols, np.cumsum(sizes)[:-1]):
                if used < limit and x.any():
                    parts.append(x[: limit - used])
                    used += len(parts[-1])
            if parts:
                points[name] = parts
        alphabet = np.unique(np.concatenate([np.zeros(1, np.int32), *(x for p in points.values() for x in p)]))
        cut, width = len(alphabet) + 1, len(alphabet) + 2  # classes: blank, letters, other letters, an end of text
        keys, values, roots, bits, base = [], [], [], [], 0
        first = np.full((len(points), width), -1, np.int64)
        for n, parts in enumerate(points.values()):
            row: list[int] = []
            for x in parts:
                row += [*np.searchsorted(alphabet, x).tolist(), cut]
            automaton = suffix_automaton(row)
            first[n, list(automaton[0])] = [base + t for t in automaton[0].values()]
            keys.append(np.fromiter(((base + k) * width + c for k, t in enumerate(automaton) for c in t), np.int64))
            values.append(np.fromiter((base + v for t in automaton for v in t.values()), np.int64))
            roots.append(base)
            bits.append(math.log2(len(row) + 1))
            base += len(automaton)
        none = [np.zeros(0, np.int64)]
        steps = Placed(np.concatenate(keys or none), np.concatenate(values or none), width, base)
        return Languages(list(points), alphabet, steps, steps.place[np.array(roots, dtype=np.int64)], np.where(first < 0, -1, steps.place[first]) if base else first, np.array(bits))

    def _begins(self, state: np.ndarray, open_: np.ndarray, c: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One symbol further: whether a phrase begins with it, the state, and whether the phrase is still open."""
        found = self.steps.entries[state + c]
        none = (found >> self.steps.low) != state
        to = found & self.steps.mask
        begins, open_ = ~open_ | none, np.ones(none.shape, bool)
        # Where there is no way on, the symbol begins a phrase.
        at = np.nonzero(none)
        lang = at[0] if none.ndim == 2 else lang[at]
        again = self.first[lang, c[at[-1]]]
        lone = again < 0  # a letter that the language lacks is a phrase by itself
        to[at], open_[at] = np.where(lone, self.roots[lang], again), ~lone
        return begins, to, open_

    def phrases(self, classes: np.ndarray, sizes: np.ndarray, entry: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Phrases of each text (rows) against each language (columns), and the states that the last text ends with.

        ``entry``: states that the one text goes on from; the phrase open there isn't counted.
        """
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (np.cumsum(sizes) - sizes)[owner] + nth * PIECE
        length = np.minimum(PIECE, sizes[owner] - nth * PIECE)
        n = len(self.names)
        starts_here = np.zeros((n, len(classes)), bool)
        state, open_ = np.repeat(self.roots[:, None], len(start), axis=1), np.zeros((n, len(start)), bool)
        count = np.zeros((n, len(start)), np.int64)
        order = np.argsort(-length, kind="stable")
        s, o, t = state[:, order], open_[:, order], start[order]
        active, lengths = len(start), length[order]
        for k in range(int(lengths[0]) if len(lengths) else 0):
            while lengths[active - 1] <= k:
                active -= 1
            at = t[:active] + k
            begins, s[:, :active], o[:, :active] = self._begins(s[:, :active], o[:, :active], classes[at], None)
            starts_here[:, at] = begins
        state[:, order], open_[:, order] = s, o
        for k in range(n):
            upto = np.concatenate([[0], np.cumsum(starts_here[k])])
            count[k] = upto[start + length] - upto[start]

        # Enter pieces with what their predecessors left open, until no end changes any more.
        follows = np.nonzero(nth > 0)[0]
        lang, piece = np.repeat(np.arange(n), len(follows)), np.tile(follows, n)
        from_state, from_open = state[lang, piece - 1], open_[lang, piece - 1]
        if entry is not None and len(start):
            lang, piece = np.concatenate([lang, np.arange(n)]), np.concatenate([piece, np.zeros(n, np.int64)])
            from_state, from_open = np.concatenate([from_state, entry[0]]), np.concatenate([from_open, entry[1]])
        plain_state, plain_open = state.copy(), open_.copy()
        while len(lang):
            count[lang, piece], apart, end_state, end_open = self._enter(classes, start, length, starts_here, lang, piece, from_state, from_open)
            # Where both parses never met, the piece may have another end, and the next one another beginning.
            end_state, end_open = np.where(apart, end_state, plain_state[lang, piece]), np.where(apart, end_open, plain_open[lang, piece])
            new = (end_state != state[lang, piece]) | (end_open != open_[lang, piece])
            lang, piece, from_state, from_open = lang[new], piece[new], end_state[new], end_open[new]
            state[lang, piece], open_[lang, piece] = from_state, from_open
            more = piece + 1 < len(start)
            more[more] = nth[piece[more] + 1] > 0
            lang, piece, from_state, from_open = lang[more], piece[more] + 1, from_state[more], from_open[more]
        out = np.zeros((n, len(sizes)), np.int64)
        for k in range(n):
            out[k] = np.bincount(owner, count[k], len(sizes))
        return out.T, (state[:, -1], open_[:, -1]) if len(start) else (entry or (self.roots, np.zeros(n, bool)))

    def _enter(self, classes: np.ndarray, start: np.ndarray, length: np.ndarray, plain: np.ndarray, lang: np.ndarray, piece: np.ndarray, state: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, ...]:
        """Phrases that begin in pieces entered with open ones; whether they ended apart from the plain parse, and how.

        ``plain`` has the beginnings of the plain parse of all pieces.
        """
        total = np.zeros(len(lang), np.int64)
        apart, end_state, end_open = np.zeros(len(lang), bool), state.copy(), open_.copy()
        on, state, open_ = np.arange(len(lang)), state.copy(), open_.copy()
        met = np.full(len(lang), -1, np.int64)
        k = 0
        while len(on):
            over = length[piece[on]] <= k
            if over.any():
                gone = on[over]
                apart[gone], end_state[gone], end_open[gone] = True, state[over], open_[over]
                on, state, open_ = on[~over], state[~over], open_[~over]
                continue
            at = start[piece[on]] + k
            begins, state, open_ = self._begins(state, open_, classes[at], lang[on])
            both = begins & plain[lang[on], at]
            met[on[both]] = at[both]
            total[on] += begins & ~both
            on, state, open_ = on[~both], state[~both], open_[~both]
            k += 1
        # From where both met, the plain parse's beginnings count.
        for n in np.unique(lang[met >= 0]).tolist():
            here = np.nonzero((lang == n) & (met >= 0))[0]
            upto = np.concatenate([[0], np.cumsum(plain[n])])
            total[here] += upto[(start + length)[piece[here]]] - upto[met[here]]
        return total, apart, end_state, end_open

    def _classes(self, symbols: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at, len(self.alphabet)).astype(np.int32)

    def _count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases against each language, symbols, and whether there are letters, of each text."""
        symbols, sizes = squeezed(*letters(texts))
        starts = np.cumsum(sizes) - sizes
        has = (np.add.reduceat(np.append(symbols, 0) > 0, starts) > 0) & (sizes > 0) if len(sizes) else sizes > 0
        return self.phrases(self._classes(symbols), sizes)[0], sizes, has

    def _count_long(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of one text, in parts."""
        entry, begun, total, count, has = None, False, 0, np.zeros((1, len(self.names)), np.int64), False
        for start in range(0, len(text), PART_CHARS):
            symbols, sizes = squeezed(*letters(pa.array([text[start : start + PART_CHARS]], pa.string())), begun)
            if len(symbols):
                found, entry = self.phrases(self._classes(symbols), sizes, entry)
                count, total, has, begun = count + found, total + len(symbols), has or bool(symbols.any()), bool(symbols[-1] != BLANK)
        return count, np.array([total]), np.array([has])

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text the language, the score, and the bits per symbol of that language."""
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        counts, sizes, has = np.zeros((len(texts), len(self.names)), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        long = np.asarray(pc.fill_null(pc.utf8_length(texts), 0)) > PART_CHARS
        counts[~long], sizes[~long], has[~long] = self._count(texts.filter(pa.array(~long)))
        for k in np.nonzero(long)[0].tolist():
            counts[k], sizes[k], has[k] = (x[0] for x in self._count_long(texts[k].as_py()))
        rate = np.maximum(counts * self.bits / np.maximum(sizes, 1)[:, None], 1e-9)
        best = rate.argmin(1)
        least = rate[np.arange(len(best)), best]
        score = (1 / least) / (1 / rate).sum(1)
        return [self.names[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0), np.where(has, least, 0.0)


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Automata from the labelled rows of ``df`` (a bounded sample of each language's)."""
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("odd", ~F.length("text").between(200, 8000))
    # Copies are one: numbers of hashes, not of rows, are taken, and texts are read for these only.
    # The first of each share of a language, and then of all: no task sees a whole language.
    chosen = rows.select("lang", "odd", "mark").distinct().withColumn("share", F.pmod("mark", F.lit(SHARES)))
    for part in (["lang", "share"], ["lang"]):
        order = Window.partitionBy(*part).orderBy("odd", "mark")
        chosen = chosen.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_TEXTS)
    # SAMPLE_TEXTS rows of three numbers for each language: that is the bound of the broadcast.
    found = rows.join(F.broadcast(chosen.drop("share")), ["lang", "odd", "mark"]).select("lang", "k", F.substring("text", 1, SAMPLE_SYMBOLS).alias("text"))
    samples: dict[str, list[str]] = {}
    for r in found.groupBy("lang", "k").agg(F.min("text").alias("text")).orderBy("lang", "k").collect():
        samples.setdefault(r.lang, []).append(r.text)
    return Languages.learn(samples)


def identify(df: DataFrame, languages: Languages, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score, bits (per symbol); columns of these names are replaced."""
    sent = df.sparkSession.sparkContext.broadcast(languages)
    added = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])
    df = df.drop(*added.names)
    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text):
            found = out_batch(list(sent.value.predict(string(batch.column(text)))), added)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found.columns], names=[*names, *added.names])

    return df.mapInArrow(run, f"{fields}, lang_pred string, score double, bits double")

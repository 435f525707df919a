"""Decontamination, language id, quality."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from permitloom.llm import decontaminate, langid, quality, queries

SF = "/root/testdata/sf0.01"


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(1)
    items = {k: words(rng, n) for k, n in enumerate([40, 15, 60, 8, 3, 20])}
    around = lambda x: " ".join([*words(rng, 50), *x, *words(rng, 50)])

    def changed(x, every):
        return [w if (k + 1) % every else "other" for k, w in enumerate(x)]

    docs = {
        1: around(items[0]), 2: around(changed(items[0], 6)), 3: around(items[1]), 4: around([w.upper() + "," for w in items[2]]),
        5: around(items[2][20:36]), 6: around(items[3]), 7: around(items[4]), 8: around(items[2][:6]), 9: around(words(rng, 200)),
        10: None, 11: "", 12: " ".join(items[5]), 13: around(changed(items[3], 4)), 14: around([*items[0], *items[1]]),
    }
    df = spark.createDataFrame([(k, t, 0) for k, t in docs.items()] + [(1, docs[1], 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()] + [(8, None), (9, ""), (10, "...")], "item_id long, text string")
    found = decontaminate.contamination(df, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 0), (1, 0), (2, 0), (3, 1), (4, 2), (5, 2), (6, 3), (12, 5), (14, 0), (14, 1)]
    assert {r.covered_words for r in found if r.doc_id == 1} == {40} and {r.start_word for r in found if r.doc_id == 1} == {50}
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [7, 8, 9, 10, 11, 13]
    assert decontaminate.contamination(df, bench.limit(0)).count() == 0 and decontaminate.clean(df, bench.limit(0)).count() == 15


def agreeing(doc, item):
    """The item's words that alignments of the two cover, by the definition and nothing else."""
    covered, n = set(), len(item)
    for lined in range(1 - n, len(doc)):
        equal = [0 <= lined + k < len(doc) and doc[lined + k] == item[k] for k in range(n)]
        inside = [k for k in range(n) if 0 <= lined + k < len(doc)]
        if 10 * sum(equal) >= 8 * n:
            covered |= {k for k in range(n) if equal[k]}
        for s in range(n - 7):
            if s in inside and s + 7 in inside and sum(equal[s : s + 8]) >= 7:
                covered |= {k for k in range(s, s + 8) if equal[k]}
    return covered


def brute_contamination(docs, items):
    """(key, item, covered words) of contaminated documents."""
    split = lambda t: decontaminate.plain_words(pa.array([t or ""]))[1].to_pylist()
    items = [(k, split(t)) for k, t in items]
    out = []
    for key, text in docs:
        doc = split(text)
        for name, item in items:
            if len(item) >= 5 and len(set(doc) & set(item)) >= 4:
                n = len(agreeing(doc, item))
                if n >= min(13, -(-len(item) * 8 // 10)):
                    out.append((key, name, n))
    return sorted(out, key=str)


def test_contamination_against_brute_force(spark, monkeypatch):
    """The query, and the way of a large benchmark, against the definition on a few documents."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = queries.op1_decontaminate(spark, "/root/testdata/sf0.001").collect()
    some = {r.doc_id for r in got} | {r.doc_id for r in docs.where("doc_id % 5 = 0").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in some and len(r.text or "") < 20_000]
    want = brute_contamination(rows, [tuple(r) for r in bench.collect()])
    assert sorted(((r.doc_id, r.item_id, r.covered_words) for r in got if r.doc_id in dict(rows)), key=str) == want and want


def test_large_benchmark(spark, monkeypatch):
    """Joined by hash as a table, a benchmark gives what it gives when it is sent around."""
    rng = random.Random(5)
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(9000 + n, " ".join(words(rng, n))) for n in (3, 5, 7, 9, 10, 14)] + [(9100, None), (9101, ""), (9000, "twice " * 9), (9000, "twice " * 9)]
    texts = [(None, f"a b {items[1][1]} c"), (None, None), (70, items[4][1]), (70, items[4][1]), (71, items[5][1].replace(" ", " odd ", 1)), (72, items[3][1] + " x"), (73, "twice " * 30), (74, f"{items[0][1].upper()}!"), (75, f"{items[0][1]} more")]
    bench = bench.select("item_id", "text").unionByName(spark.createDataFrame(items, "item_id long, text string"))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string")).withColumn("m1", F.lit("clash"))
    whole = sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=str)
    assert [r[1:] for r in whole if r[0] in (74, 75)] == [(9003, 3, 3, 3, 0)]
    left = sorted(map(tuple, decontaminate.clean(docs, bench).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=str) == whole and len(whole) > 8
    assert sorted(map(tuple, decontaminate.clean(docs, bench).collect()), key=str) == left
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_random_substitutions():
    """Of copies of items of 5 to 60 words with words changed at random, all in which 80 % remain are found, and no others but longer ones."""
    rng = random.Random(8)
    items = [words(rng, n) for n in (5, 6, 7, 8, 9, 10, 12, 15, 17, 20, 25, 40, 60)]
    texts, want, maybe = [], set(), set()
    for i, x in enumerate(items):
        for share in (0.05, 0.1, 0.15, 0.2):
            for _ in range(60):
                copy = [f"odd{rng.randrange(10**9)}" if rng.random() < share else w for w in x]
                same = sum(a == b for a, b in zip(copy, x, strict=True))
                (want if 10 * same >= 8 * len(x) else maybe).add((len(texts), i))
                texts.append(" ".join([*words(rng, 9), *copy, *words(rng, 9)]))
    block = decontaminate.Block.of([(k, " ".join(x)) for k, x in enumerate(items)])
    got = {(r, i) for r, i, *_ in block.overlaps(pa.array(texts))}
    assert want <= got <= want | maybe and all(len(items[i]) > 12 for r, i in got - want)


def test_short_items():
    """Copies of items of 5 to 10 words with as many words changed, or cut off by the text's ends, as 80 % allows; 4 words count where they are the whole text."""
    rng = random.Random(7)
    texts, want = [], set()
    items = [words(rng, n) for n in (4, 5, 6, 7, 8, 9, 10)]
    for i, x in enumerate(items):
        n = len(x)
        other = n - -(-8 * n // 10)
        for gone in [set(), *({a} for a in range(n)), *({a, b} for a in range(n) for b in range(a))]:
            copy = ["other" if k in gone else w for k, w in enumerate(x)]
            cut = " ".join([w for k, w in enumerate(x) if k not in gone])
            edge = gone in ({0}, {n - 1}, {0, 1}, {n - 1, n - 2}, {0, n - 1})
            for t in [" ".join([*words(rng, 9), *copy, *words(rng, 9)]), " ".join(copy), *([cut] if edge else [])]:
                if len(gone) <= other and (n > 4 or len(t.split()) == n):
                    want.add((len(texts), i, n - len(gone)))
                texts.append(t)
    block = decontaminate.Block.of([(k, " ".join(x)) for k, x in enumerate(items)])
    assert {(r, i, c) for r, i, c, _, _ in block.overlaps(pa.array(texts))} == want
    assert {(n, at) for r, i, c, n, at in block.overlaps(pa.array(["a b " + " ".join(items[-1])]))} == {(10, 2)}


def test_shared_template(monkeypatch):
    """Many items with a common beginning, in a text that repeats it: few hits are held at once, none is lost."""
    rng = random.Random(4)
    template = words(rng, 14)
    items = [(k, " ".join([*template, *(f"own{k}x{j}" for j in range(20))])) for k in range(300)]
    text = " ".join([" ".join([*template, *words(rng, 3)]) for _ in range(200)])
    block = decontaminate.Block.of(items)
    monkeypatch.setattr(decontaminate, "HITS", 5000)
    monkeypatch.setattr(decontaminate, "WORDS", 20_000)
    assert [(r, i, c, n, at) for r, i, c, n, at in block.overlaps(pa.array([text, "", None]))] == [(0, k, 14, 14, 0) for k in range(300)]


def phrases(text, sample):
    count = 0
    while text:
        n = 0
        while n < len(text) and text[: n + 1] in sample:
            n += 1
        text, count = text[max(n, 1) :], count + 1
    return count


def plain_letters(text):
    return "".join(" " if s == 0 else chr(s) for s in langid.squeezed(*langid.letters(pa.array([text])))[0])


def brute_phrases(samples, texts):
    learned = {k: "\n".join(map(plain_letters, v)) for k, v in sorted(samples.items())}
    return [[phrases(plain_letters(t), s) for s in learned.values()] for t in texts]


def parse_texts(rng):
    letters = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    samples = {"x": [letters("abc ", 400), letters("ab", 90)], "y": [letters("bcd ", 300)]}
    texts = [letters("abcdé ", rng.randint(1, 200)) for _ in range(40)]
    # Whole copies of a sample, so that phrases go over many pieces; and texts of one letter.
    texts += [samples["x"][0] * 3, letters("de", 30) + samples["x"][0][5:] + letters("abc", 50), samples["y"][0], "b" * 500, "é" * 90, "a1" * 200, "", " 12 "]
    return samples, texts


def test_phrases_against_brute_force(monkeypatch):
    """Texts in pieces, parsed as a whole: also with pieces of few symbols."""
    samples, texts = parse_texts(random.Random(2))
    want = brute_phrases(samples, texts)
    model = langid.Languages.learn(samples)
    for piece in (1024, 64, 7, 1):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert model._count(pa.array(texts))[0].tolist() == want
        assert [model._count(pa.array([t]))[0][0].tolist() for t in texts] == want


def test_phrases_of_long_texts():
    """Beyond a piece, with phrases of all lengths."""
    rng = random.Random(5)
    samples = {"x": ["".join(rng.choice("abcdefgh ") for _ in range(5000))]}
    text = "".join(samples["x"][0][k : k + rng.choice([1, 3, 40, 1500])] for k in (rng.randrange(4000) for _ in range(60)))
    assert len(text) > 5000
    assert langid.Languages.learn(samples)._count(pa.array([text]))[0].tolist() == brute_phrases(samples, [text])


def test_languages_in_parts(monkeypatch):
    """A text in parts is predicted as a whole one, to the last bit."""
    samples, texts = parse_texts(random.Random(3))
    model = langid.Languages.learn(samples)
    whole = model.predict(pa.array([*texts, None]))
    for part, piece in ((17, 1024), (100, 7), (1, 1)):
        monkeypatch.setattr(langid, "PART_CHARS", part)
        monkeypatch.setattr(langid, "PIECE", piece)
        parts = model.predict(pa.array([*texts, None]))
        assert whole[0] == parts[0] and (whole[1] == parts[1]).all() and (whole[2] == parts[2]).all()


def test_size_of_automata():
    """A language of 3,000 letters takes no more room than one of 60, a symbol of the sample at most 100 bytes."""
    rng = random.Random(1)
    for n in (60, 3000):
        model = langid.Languages.learn({"x": ["".join(chr(0x4E00 + rng.randrange(n)) for _ in range(40_000))]})
        assert model.steps.entries.nbytes < 100 * 40_000
    assert model.predict(pa.array(["\u4e00" * 30]))[0] == ["x"]


def test_copies_are_one_sample(spark, monkeypatch):
    """Many copies of a text don't fill a language's sample."""
    monkeypatch.setattr(langid, "SAMPLE_TEXTS", 3)
    rows = [(f"{w} " * 60, "a") for w in ("one", "two", "three")] + [("one " * 60, "a")] * 30 + [("two " * 60, "a")] * 30
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert model._count(pa.array(["one", "two", "three"]))[0].tolist() == [[1], [1], [1]]


def test_suffix_automaton_holds_all_substrings():
    rng = random.Random(3)
    s = [rng.randrange(3) for _ in range(60)]
    t = langid.suffix_automaton(s)
    inside = {tuple(s[a:b]) for a in range(60) for b in range(a, 61)}
    for _ in range(3000):
        w, at = tuple(rng.randrange(3) for _ in range(rng.randint(1, 7))), 0
        for c in w:
            at = t[at].get(c, -1) if at >= 0 else -1
        assert (at >= 0) == (w in inside)


def test_steps():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    table = langid.Steps(keys, np.arange(len(keys)))
    assert (table(keys) == np.arange(len(keys))).all() and (table(keys[:100].reshape(10, 10)) == np.arange(100).reshape(10, 10)).all()
    assert (table(np.setdiff1d(np.arange(5000), keys)) == -1).all()
    wide = langid.Steps(keys << 20, np.arange(len(keys)) << 20)  # too wide for one number
    assert wide.apart is not None and (wide(keys << 20) == np.arange(len(keys)) << 20).all() and (wide(keys) == -1).all()


def test_places_of_states_do_not_clash():
    """Every way is found by one access, and no other; states without a way have places of their own."""
    rng = random.Random(5)
    automaton = langid.suffix_automaton([rng.randrange(40) for _ in range(6000)])
    ways = {(k, c): v for k, t in enumerate(automaton) for c, v in t.items()}
    keys, values = np.array([k * 42 + c for k, c in ways]), np.array(list(ways.values()))
    shuffled = np.random.default_rng(2).permutation(len(keys))
    table = langid.Placed(keys[shuffled], values[shuffled], 42, len(automaton))
    assert len(np.unique(table.place)) == len(automaton) and (table.place >= 0).all()
    found = table.entries[table.place[:, None] + np.arange(42)]
    there = (found >> table.low) == table.place[:, None]
    assert there.sum() == len(ways) and all(there[k, c] and found[k, c] & table.mask == table.place[v] for (k, c), v in ways.items())
    assert langid.Placed(np.zeros(0, np.int64), np.zeros(0, np.int64), 2, 0).entries.max() == -1


def test_many_languages():
    """A thousand languages with ten thousand letters."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 10_000)]
    samples = {f"l{k:04}": ["".join(letters[(k * 10 + j) % 10_000] for j in range(30))] for k in range(1000)}
    found = langid.Languages.learn(samples).predict(pa.array([samples["l0007"][0], samples["l0500"][0]]))
    assert list(found[0]) == ["l0007", "l0500"]


def test_languages(spark):
    got = {r.doc_id: r for r in queries.op6_langid(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(got[d.doc_id].held_out == (d in held) for d in docs) and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.98


def test_language_query_against_a_plain_parse(spark, monkeypatch):
    """Each row's language and score, from the samples that were learned and nothing else of the operator."""
    taken, learn, small = {}, langid.Languages.learn, "/root/testdata/sf0.001"

    def watched(samples, limit=langid.SAMPLE_SYMBOLS):
        taken.update(samples)
        return learn(samples, limit)

    monkeypatch.setattr(langid.Languages, "learn", staticmethod(watched))
    got = {r.doc_id: r for r in queries.op6_langid(spark, small).collect()}
    names, whole, bits = sorted(taken), [], []
    for name in names:
        parts, left = [], langid.SAMPLE_SYMBOLS
        for text in map(plain_letters, taken[name]):
            if left > 0 and text.strip():
                parts.append(text[:left])
                left -= len(parts[-1])
        whole.append("\n".join(parts))
        bits.append(math.log2(sum(len(x) + 1 for x in parts) + 1))
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    short = [d for d in docs if len(d.text or "") < 4000]
    assert len(short) > 0.7 * len(docs)
    for d in short:
        text = plain_letters(d.text or "")
        if not text.strip():
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0)
            continue
        rate = [max(phrases(text, s) * b / len(text), 1e-9) for s, b in zip(whole, bits, strict=True)]
        assert got[d.doc_id].lang_pred == names[rate.index(min(rate))]
        assert got[d.doc_id].score == pytest.approx((1 / min(rate)) / sum(1 / r for r in rate), abs=1e-12)


def test_language_edges(spark):
    train = spark.createDataFrame([("the cat and the dog " * 20, "en"), ("der hund und die katze " * 20, "de"), (None, "fr"), ("x", None)], "text string, lang string")
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the dog"), (5, "die katze"), (6, "und " * 100_000), (6, "und"), (7, "日本")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    got = langid.identify(df, langid.learn(train)).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got if r.doc_id != 7) == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, "de"), (6, "de")]
    assert all(r.lang_pred == "und" and r.score == 0 for r in langid.identify(df, langid.learn(train.limit(0))).collect())


def test_quality(spark):
    """Every row is judged, and labels that the classifier hasn't seen are met."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = quality.fit(docs, labels.where(seen))
    judged = quality.assess(docs, model, F.col("source"), F.col("lang"), columns=["doc_id"])
    rows = judged.join(labels.where(~seen), "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(bad) > 10 and sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1
    assert queries.op8_quality(spark, SF).count() == docs.count()


def log_odds(p):
    return math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))


def posteriors(rows, evidence, rate):
    """site_docs, site_rate and probability of (key, host, path) rows, by the formula of the module, in plain Python."""
    odds = lambda x: 1 / (1 + math.exp(-x))
    p = {k: odds(evidence[k] + math.log(rate / (1 - rate))) for k, _, _ in rows}
    total = sum(p.values()) / len(p)
    hosts, paths = {}, {}
    for k, host, path in rows:
        if host is not None:
            hosts.setdefault(host, []).append(p[k])
            paths.setdefault((host, path), []).append(p[k])

    def strength(groups):  # of (values, prior)
        groups = [(v, prior) for v, prior in groups if len(v) > 1]
        docs = sum(len(v) for v, _ in groups)
        if len(groups) < 2:
            return 1e6
        noise = sum(sum(x * x for x in v) - sum(v) ** 2 / len(v) for v, _ in groups) / max(docs - len(groups), 1)
        spread = (sum(len(v) * (sum(v) / len(v) - prior) ** 2 for v, prior in groups) - len(groups) * noise) / docs
        m = sum(sum(v) for v, _ in groups) / docs
        return min(1e6, max(1.0, m * (1 - m) / spread - 1)) if spread > 0 else 1e6

    k_host = strength([(v, total) for v in hosts.values()])
    k_path = strength([(v, sum(hosts[h]) / len(hosts[h])) for (h, path), v in paths.items() if path is not None])
    out = {}
    for k, host, path in rows:
        host_rate = total if host is None else (k_host * total + sum(hosts[host]) - p[k]) / (k_host + len(hosts[host]) - 1)
        v = paths.get((host, path), [])
        site = host_rate if host is None or path is None else (k_path * host_rate + sum(v) - p[k]) / (k_path + len(v) - 1)
        out[k] = len(v), site, odds(evidence[k] + log_odds(site))
    return out


def test_sites_shrink(spark):
    """Posteriors equal the formula in plain Python; sparse sites stay near the rate."""
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for host, share, n in (("good", 0.95, 200), ("bad", 0.1, 200), ("tiny", 0.0, 1), ("mixed", 0.5, 60), (None, 0.5, 5)):
        for _ in range(n):
            good = rng.random() < (share if k % 3 else share / 2)
            rows.append((k, "plain words of a text" if good else "### $$$ %%%", host, None if k % 5 == 0 else f"p{k % 3}"))
            k += 1
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, host string, path string, kept int")
    labels = spark.createDataFrame([(r[0], int("plain" in r[1])) for r in rows if r[0] % 2] + [(1, None), (None, 1), (3, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    out = {r.doc_id: r for r in quality.assess(df, model, F.col("host"), F.col("path")).collect()}
    assert len(out) == len(rows)
    want = posteriors([(r[0], r[2], r[3]) for r in rows], {k: r.evidence for k, r in out.items()}, model.rate)
    for k, (docs, site, probability) in want.items():
        assert out[k].site_docs == docs and abs(out[k].site_rate - site) < 1e-9 and abs(out[k].probability - probability) < 1e-9
    rate = lambda h: np.mean([out[r[0]].site_rate for r in rows if r[2] == h])
    assert rate("good") > 0.6 and rate("bad") < 0.3 and 0.2 < rate("tiny") < 0.8
    assert all(out[r[0]].kept == ("plain" in r[1]) for r in rows)
    # A probability at the threshold is kept.
    edge = out[7].probability
    again = {r.doc_id: r.kept for r in quality.assess(df, model, F.col("host"), F.col("path"), threshold=edge).collect()}
    assert again[7] and all(again[k] == (r.probability >= edge) for k, r in out.items())


def test_quality_query_against_the_formula(spark):
    """Each row of the query: its evidence by the classifier's numbers, and the rest by plain sums."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model, rows = quality.fit(docs, labels), docs.collect()
    z = np.clip((quality.features(pa.array([d.text or "" for d in rows])) - model.mean) / model.scale, -8, 8)
    evidence = {d.doc_id: float(np.clip((row * model.weights).sum() + model.offset, -20, 20)) for d, row in zip(rows, z, strict=True)}
    got = {r.doc_id: r for r in queries.op8_quality(spark, SF).collect()}
    want = posteriors([(d.doc_id, d.source, d.lang) for d in rows], evidence, model.rate)
    assert set(got) == set(want) and len(got) == len(rows)
    for k, (n, site, probability) in want.items():
        r = got[k]
        # The whole probability is the document's odds times those of its site.
        assert r.site_docs == n and r.evidence == pytest.approx(evidence[k], abs=1e-6)
        assert r.site_rate == pytest.approx(site, abs=1e-6) and r.probability == pytest.approx(probability, abs=1e-6) and r.kept == (r.probability >= 0.5)


def test_repeated_labelled_documents(spark):
    """One text teaches of each key, whatever is repeated, and which doesn't depend on the order."""
    rows = [(1, "good words here")] * 40 + [(1, "other words")] + [(2, "### $$")] * 3
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (quality.fit(x, labels) for x in (df, df.orderBy(F.desc("text")).repartition(3)))
    assert (a.weights == b.weights).all() and a.rate == b.rate == 0.5


def test_site_of_pages(spark):
    """Host and path of URLs as sites."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(F.col("page_id").alias("doc_id"), "url", F.col("html").alias("text"))
    host, path = quality.url_site(F.col("url"))
    labels = pages.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rows = quality.assess(pages, quality.fit(pages, labels), host, path).collect()
    assert len(rows) == pages.count() and all(r.site_docs >= 1 for r in rows if r.url and "://" in r.url)


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, "", "h", None), (2, "x " * 200_000, "h", "p")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    clash = df.withColumns({c: F.lit("mine") for c in ("n", "s", "host_n", "key", "y", "evidence", "kept")})
    rows = quality.assess(clash, quality.fit(clash, none), F.col("source"), F.col("lang")).collect()
    assert all(r.n == r.s == r.host_n == r.key == r.y == "mine" for r in rows) and len(rows) == 3 and all(abs(r.probability - 0.5) < 1e-6 for r in rows)
    assert quality.assess(df.limit(0), quality.fit(df, none), F.col("source"), F.col("lang")).count() == 0
    host, path = quality.url_site(F.col("u"))
    got = spark.createDataFrame([("http://A.b.org:80/x/y?z",), ("https://u@c.d",), ("junk",), (None,)], "u string").select(host, path).collect()
    assert [tuple(r) for r in got] == [("a.b.org", "x"), ("c.d", None), (None, None), (None, None)]

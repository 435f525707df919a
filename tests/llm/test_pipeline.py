"""The pipeline's stages and rows, against each operator's brute force."""

import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from permitloom.llm import decontaminate, langid
from permitloom.llm.common import written

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [k for k, q in labels.items() if q == 1]
    bad = [k for k, q in labels.items() if q == 0]
    first = kept["quality classifier"]
    assert sum(k in first for k in good) / len(good) > 0.98 and sum(k in first for k in bad) / len(bad) < 0.2
    assert len(first - kept["language id"]) < 0.01 * len(first)
    assert kept["minhash near-dedup"] < kept["language id"]
    left = docs.collect()
    assert decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in left} and all(r.round_trip for r in rows)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in left}
    assert all(r.ids == model.encode(texts[r.doc_id]) for r in rows)


def copy_of(spark, folder, documents, **other):
    """A folder of tables with these documents; the others are the driver's unless given."""
    documents.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        other.get(name, spark.read.parquet(f"{SF}/{name}.parquet")).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeats, ties and clashing columns go by the rules of the module."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and n_chars between 500 and 5000").orderBy("doc_id").limit(120)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    good = [r.text for r in docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("quality = 1").orderBy("doc_id").limit(6).collect()]
    a, b, c = good[0], good[1], good[2]
    odd = [(None, a), (None, a), (9001, None), (9002, ""), (9003, "12 !! 34"), (9004, b), (9004, c), (9004, b), (9005, " ".join(texts[:40] * 12)), (9006, f"{good[3]} {item}"), (9007, c), (9008, None)]
    rows = spark.createDataFrame([(k, t, None, None, None) for k, t in odd], docs.schema)
    names = ["score", "kept", "bits", "row", "mark", "key", "ids", "component_id"]
    both = docs.unionByName(rows).withColumns({n: F.lit(f"mine {n}") for n in names})
    folder = copy_of(spark, tmp_path / "odd", both)
    stage, kept = both, {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = written(f(spark, stage, folder), "stage")
        assert stage.columns == both.columns and stage.where(" or ".join(f"cast(`{n}` as string) != 'mine {n}'" for n in names)).isEmpty()
        kept[name] = [(r.doc_id, r.text) for r in stage.collect()]
    before, found = kept["language id"], kept["minhash near-dedup"]
    assert not {9001, 9002, 9003, 9008} & {k for k, _ in before} and before.count((None, a)) == 2
    # Rows with null keys stay; of a key's texts those go that an earlier key has.
    assert found.count((None, a)) == 2 and not [k for k, t in found if k == 9004 and t in (b, c)] and (9007, c) not in found
    assert 9006 not in {k for k, _ in kept["benchmark decontamination"]}
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"]
    assert sorted((str(r.doc_id) for r in out.collect())) == sorted(str(k) for k, _ in kept["benchmark decontamination"])


def test_no_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.run(spark, copy_of(spark, tmp_path / "no_docs", docs.limit(0))).count() == 0
    few = docs.where("doc_id % 20 = 3 and n_chars between 300 and 3000")
    none = {t: spark.read.parquet(f"{SF}/{t}.parquet").limit(0) for t in ("labels", "benchmark")}
    folder = copy_of(spark, tmp_path / "no_labels", few, **none)
    assert corpus_pipeline.good_quality(spark, few, folder).count() == corpus_pipeline.no_benchmark(spark, few, folder).count() == few.count()


def test_bound_of_known_languages(spark):
    """What the bound keeps (texts held out of learning) and drops (a language left out of learning)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    held = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2) & (letters >= corpus_pipeline.LEAST_LETTERS)
    fits = lambda some, learned: [r.bits <= corpus_pipeline.MOST_BITS for r in langid.identify(some, langid.learn(learned)).select("bits").collect()]
    known = fits(docs.where(held), docs.where(~held))
    assert sum(known) / len(known) > 0.99
    strange = fits(docs.where("lang = 'es'").where(held), docs.where("lang != 'es'").where(~held))
    assert sum(strange) / len(strange) < 0.1

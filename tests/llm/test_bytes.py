"""Texts that are no UTF-8, and paths of other stores."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from permitloom.llm import chat, decontaminate, langid, minhash, pieces, quality, token_counts, token_files
from permitloom.llm.common import string, written
from permitloom.operators.files import arrow_uri

BYTES, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    """Two documents of broken bytes, one of which is what the other becomes, from a table."""
    text = lambda t: F.concat(F.lit("some words that stand here "), F.expr(t))
    rows = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), text("cast(X'61FF62' as string)").alias("text"))
    return written(rows.unionByName(spark.range(1).select(F.lit(2).cast("long").alias("doc_id"), text("'a\ufffdb'").alias("text"))), "broken")


def same(rows, *columns):
    rows = {r[0]: [r[c] for c in columns] for r in rows.collect()}
    assert set(rows) == {1, 2} and rows[1] == rows[2]
    return rows[1]


def test_every_operator(spark, docs):
    item = spark.createDataFrame([(5, "some words that stand here a b")], "item_id long, text string")
    assert same(decontaminate.contamination(docs, item), "item_id", "covered_words") == [5, 7]
    assert decontaminate.clean(docs, item).count() == 0 and decontaminate.clean(docs, item.limit(0)).count() == 2
    tokens = token_files.read_tokens(spark, token_files.write_tokens(docs, BYTES, end_id=2))
    assert same(tokens, "n_tokens")[0] > 7
    assert same(pieces.encode_checked(docs, public_tokenizers.path("piece_bpe_32k.model"), ids="found").select("doc_id", "found.*"), "ids", "round_trip")[1]
    learned = langid.learn(docs.withColumn("lang", F.lit("en")))
    assert same(langid.identify(docs, learned), "lang_pred") == ["en"]
    assert same(token_counts.count_tokens(docs, WORD, 5), "n_tokens", "over_limit")[1]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    same(quality.assess(docs, quality.fit(docs, labels), F.lit("h"), F.lit("p")), "evidence")
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == {1}
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), "text")
    same(chat.read_back(written(chat.format_chats(turns), "chats")), "turns_sha256")


def test_whole_arrays():
    import pyarrow as pa

    broken = pa.Array.from_buffers(pa.string(), 4, pa.array([b"a", None, b"\xff", "é".encode()]).buffers())
    assert string(broken).to_pylist() == ["a", None, "\ufffd", "é"] and string(broken.slice(3)).to_pylist() == ["é"]
    assert string(pa.array(["x"], pa.large_string())).type == pa.string()


def test_paths_of_other_stores():
    assert arrow_uri("s3a://b/k") == "s3://b/k" and arrow_uri("s3://b/k") == "s3://b/k"
    assert arrow_uri("wasbs://c@acc.blob.core.windows.net/k") == "abfss://c@acc.dfs.core.windows.net/k"
    assert arrow_uri("file:/tmp/x") == "file:///tmp/x" == arrow_uri("file:///tmp/x") and arrow_uri("hdfs:///x") == "hdfs://default/x" and arrow_uri("/tmp/x") == "/tmp/x"

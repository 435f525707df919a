"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes each
result to the shared folder and reads it again as the next stage's docs.

Rules, by which every row is decided; a row is never dropped for what the rules don't name:

* A null or empty text is judged by the quality classifier like any other, and rejected by
  language id, which rejects all texts without letters.
* Rows with a null doc_id are judged by their texts alone: near-dedup never drops them.
* Of a group of near copies the document with the smallest doc_id stays, and of several texts under
  that doc_id one; other texts of a key of which one is a copy stay.  Rows that repeat one text
  under one doc_id are one document, and stay or go together.
* A long text is read whole by every stage.
* An empty table of documents passes as an empty one; without labels of both kinds the
  classifier keeps all, and without a benchmark nothing is contaminated.
* All but the last stage keep the columns of ``documents``, extra ones too, whatever their names;
  the last returns doc_id, lang, source, ids, n_tokens, round_trip.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitloom.llm import decontaminate, langid, minhash, pieces, quality
from permitloom.llm.common import remove, scratch

#: A text of at least so many letters whose best language needs more bits per symbol is in none of them.
#: Texts of learned languages need 2.4 bits (median), 4.2 (99.9 %), 4.8 (most) held out of learning on
#: ``sf0.1``; those of a language left out of learning 5.1 to 7.4 (5 %), so all but a few of these go.
LEAST_LETTERS, MOST_BITS = 40, 5.0


def hidden(docs: DataFrame) -> DataFrame:
    """The columns under names that no operator gives to its own."""
    return docs.toDF(*[f"doc__{c}" for c in docs.columns])


def shown(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"doc__{c}").alias(c) for c in names])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is more likely good than bad, by evidence and site."""
    classifier = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.assess(hidden(docs), classifier, F.col("doc__source"), F.col("doc__lang"), text="doc__text")
    return shown(judged.where("kept"), docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages: no text without letters, none that fits no language."""
    found = langid.identify(hidden(docs), langid.learn(docs), text="doc__text")
    letters = F.length(F.regexp_replace(F.coalesce("doc__text", F.lit("")), r"[^\p{L}]", ""))
    strange = (letters >= LEAST_LETTERS) & (F.col("bits") > MOST_BITS)
    return shown(found.where((F.col("lang_pred") != "und") & ~strange), docs.columns)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; of a key with several texts only those go that are copies."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"), by_key=False)
    copies = found.where("not kept").select(F.col("doc_id").alias("__copy"), F.col("text_mark").alias("__mark")).distinct()
    same = (F.col("doc_id") == F.col("__copy")) & (F.xxhash64("text") == F.col("__mark"))
    return docs.join(copies, same, "left_anti").select(*docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and whether they decode to its text again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.encode_checked(docs.select("doc_id", "lang", "source", "text"), model, ids="found").select("doc_id", "lang", "source", "found.*")
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality classifier", good_quality),
    ("language id", known_language),
    ("minhash near-dedup", no_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("sentencepiece", encoded),
]

#: Suffix automata, trained classifiers and piece models are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        old, path = path, scratch(spark, name.replace(" ", "-"))
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if old:
            remove(spark, old)
    return docs

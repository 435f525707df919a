"""The operators applied to the driver's tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitloom.llm import chat, codes, decontaminate, langid, lexical, minhash, oracle, packing, pieces, quality, token_counts, token_files, vectors, warc
from permitloom.llm.common import written

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(spark, manifest, digest=True)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number and a hash of its ids, and whether they decode to the text again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.encode_checked(table(spark, sf_dir, "documents").select("doc_id", "text"), model, ids="found").select("doc_id", "found.*")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.near_vectors(rows, threshold=0.93, **vectors.plan_for(rows))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder, ranges = warc.archive(pages)
    return warc.read_records(warc.lookup(pages, ranges, folder), folder).drop("url", "payload")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    languages = langid.learn(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), languages).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classifier = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, classifier, F.col("source"), F.col("lang"), columns=["doc_id"])


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=5, over=75, under=100)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(written(chat.format_chats(rows), "chats"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(table(spark, sf_dir, "documents"))
    found = lexical.search(index, table(spark, sf_dir, "benchmark"), k=50)
    index.forget()
    return found


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, digest=True)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.compress(table(spark, sf_dir, "embeddings"))
    rows = codes.with_label_errors(found.codes)
    return rows.select(F.col("key").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_files": op2_token_files,
    "op3_pieces": op3_pieces,
    "op4_vectors": op4_vectors,
    "op5_warc": op5_warc,
    "op6_langid": op6_langid,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_minhash": op9_minhash,
    "op10_chat": op10_chat,
    "op11_search": op11_search,
    "op12_packing": op12_packing,
    "op13_codes": op13_codes,
}

_T = chat.TURNS
ORACLE_SQL: dict[str, str] = {
    "op4_vectors": oracle.OP4,
    "op5_warc": oracle.OP5,
    "op9_minhash": oracle.OP9,
    "op10_chat": oracle.op10(_T.all_controls(), chat.MARK, len(_T.before) + len(_T.between) + len(_T.after)),
    "op11_search": oracle.OP11,
    "op13_codes": oracle.OP13,
}

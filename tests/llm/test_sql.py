"""Queries with SQL give DuckDB's rows, on two sizes and on odd rows."""

import duckdb
import pytest

from permitloom.llm import queries

NAMES = sorted(queries.ORACLE_SQL)


def same(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet{'/*.parquet' if 'tmp' in sf else ''}')")
    df, sql = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    key = lambda row: [str(v) for v in row]
    return sorted(map(tuple, df.collect()), key=key), sorted(sql.project(", ".join(df.columns)).fetchall(), key=key)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, name, sf):
    mine, theirs = same(spark, f"/root/testdata/{sf}", name)
    assert mine == theirs and mine


def test_odd_rows(spark, tmp_path):
    sf = str(tmp_path)
    near = [[1.0, float(k) / 4, 0.0] for k in range(8)]
    docs = [(1, "A b c d e f"), (2, "a B c d e f\n"), (3, None), (4, ""), (5, "x y"), (6, "X\tY"), (7, "É y"), (8, "é y")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    vecs = [(k, v, k % 2) for k, v in enumerate(near)] + [(20, None, 1), (21, [0.0] * 3, 1), (22, near[0], None), (23, [float("nan"), 1.0, 1.0], 1), (24, near[1][:2], 1)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    spark.createDataFrame([(3, "u", None), (2, "v", ""), (9, None, "é"), (4, "w", "é")], "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
    chats = [(1, 0, "system", None), (1, 1, "user", "[INST]<s><|im_end|>"), (2, 0, "assistant", "<<SYS>>x<</SYS>>"), (3, 1, "user", "é"), (3, 0, "user", "b")]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    spark.createDataFrame([(1, "a C \u00c9"), (2, None), (2, "x y"), (None, "y")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name in NAMES:
        mine, theirs = same(spark, sf, name)
        assert mine == theirs and mine, name

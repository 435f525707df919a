"""Archives, their index, and chats."""

import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from permitloom.llm import chat, queries, warc

SF = "/root/testdata/sf0.01"


def expected(rows):
    first, out = {}, {}
    for k, _, h in sorted(rows):
        first.setdefault(h or "", k)
    for k, _, h in rows:
        data = (h or "").encode()
        f = first[h or ""]
        out[k] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if f == k else "revisit", None if f == k else f)
    return out


def facts(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def test_pages(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert facts(queries.op5_warc(spark, SF)) == expected(rows)


def test_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    rows = [(9, "http://a.org/x", "same"), (4, "http://a.org/x", "same"), (5, None, None), (6, "http://b.org/\r\nX: é", ""), (7, "junk", "é" * 300_000), (8, "http://WWW.a.org:81/p?q#f", "\r\n\r\nWARC/1.1"), *((100 + k, f"http://h{k % 5}.org/{k}", f"t{k % 11}") for k in range(60))]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    folder, ranges = warc.archive(df)
    assert sum(r["blocks"] for r in ranges) >= 66 // 3
    found = warc.read_records(warc.lookup(df, ranges, folder), folder)
    assert facts(found.drop("url", "payload")) == expected(rows)
    got = {r.page_id: r for r in found.collect()}
    assert got[6].url == "http://b.org/\r\nX: é" and bytes(got[7].payload) == ("é" * 300_000).encode() and got[9].payload is None
    for r in ranges:  # every capture, by binary search with and without the page
        index = warc.IndexFile(folder, r["path"])
        lines = [x for k in range(len(index.directory)) for x in (index._block(k), index.lines)[1]]
        assert lines == sorted(lines, key=lambda x: (x[0].encode(), x[1]))
        for x in lines:
            assert index.captures(x[0], x[1]) == [x] and index.captures(x[0]) == [y for y in lines if y[0] == x[0]]
    missing = spark.createDataFrame([(1, "http://zzz.org/")], "page_id long, url string")
    assert warc.lookup(missing, ranges, folder).count() == 0


def test_null_ids_and_repeated_pages(spark):
    rows = [(None, "http://a.org/", "same"), (3, "http://a.org/", "same"), (3, "http://a.org/", "same"), (5, "http://b.org/", "own"), (5, "http://b.org/", "own"), (5, "http://b.org/", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, ranges = warc.archive(df)
    got = warc.read_records(warc.lookup(df, ranges, folder), folder).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted([(None, "response", None), (3, "revisit", None), (3, "revisit", None), (5, "response", None), (5, "response", None), (5, "revisit", None)], key=str)


def test_equal_lines_across_blocks(spark, monkeypatch):
    """Lines of one key and page that end, fill and begin blocks are all found."""
    monkeypatch.setattr(warc, "LINES", 3)
    rows = [*((k, "http://a.org/", f"a{k}") for k in range(2)), *((7, "http://b.org/", f"b{k % 3}") for k in range(11)), *((None, None, f"n{k}") for k in range(10)), *((None, "http://c.org/", "c") for _ in range(2)), (8, "http://c.org/", "d"), (8, "http://c.org/", "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder, ranges = warc.archive(df)
    got = warc.read_records(warc.lookup(df, ranges, folder), folder).collect()
    assert sorted(((r.page_id, r.url) for r in got), key=str) == sorted(((k, u or "") for k, u, _ in rows), key=str)


def test_read_back_in_several_tasks(spark, monkeypatch):
    """An archive is read by several tasks, whose number doesn't follow from the pointers' bytes."""
    monkeypatch.setattr(warc, "READ_BYTES", 2000)
    monkeypatch.setattr(warc, "LOOKUPS", 10)
    rows = [(k, f"http://h{k % 5}.org/{k}", hashlib.sha1(str(k).encode()).hexdigest() * 20) for k in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder, ranges = warc.archive(df)
    found = warc.read_records(warc.lookup(df, ranges, folder), folder)
    # Files' names are random, and so are the tasks that their parts are dealt to; without the number it would be one.
    assert found.select(F.spark_partition_id()).distinct().count() > 5
    assert facts(found.drop("url", "payload")) == expected(rows)


def test_payloads_that_are_no_utf8(spark):
    df = spark.createDataFrame([(1, "http://a.org/", "fffe41"), (2, "http://b.org/", "41")], "page_id long, url string, hex string")
    df = df.select("page_id", F.concat(F.col("url"), F.unhex("hex").cast("string")).alias("url"), F.unhex("hex").cast("string").alias("html"))
    folder, ranges = warc.archive(df)
    got = {r.page_id: r for r in warc.read_records(warc.lookup(df, ranges, folder), folder).collect()}
    assert bytes(got[1].payload) == b"\xff\xfeA" and bytes(got[2].payload) == b"A" and got[1].url.startswith("http://a.org/") and got[1].url.endswith("A")


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder, ranges = warc.archive(df)
    assert not ranges and warc.read_records(warc.lookup(df, ranges, folder), folder).count() == 0


def test_url_keys(spark):
    urls = ["http://www.Example.com/a?b#c", "https://u@x.org:8080", "plain", None]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()] == ["com,example,www)/a?b", "org,x:8080)", ")plain", ")"]


ESCAPER = chat.Escaper(chat.TURNS.all_controls())
PARTS = st.lists(st.sampled_from([*chat.TURNS.all_controls(), "<", "[", "|", chat.MARK, "im_end|>", "/s>", "a", "\n", "s>"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), PARTS), PARTS), max_size=4))
def test_escapes_round_trip(turns):
    formatted = "".join(s["text"] for role, text in turns for s in chat.segments(chat.TURNS, ESCAPER, role, text))
    assert chat.parse(chat.TURNS, ESCAPER, formatted) == turns
    for _, text in turns:
        escaped = ESCAPER.escape(text)
        assert ESCAPER.unescape(escaped) == text and not any(c in escaped for c in chat.TURNS.all_controls())


def test_bad_controls():
    with pytest.raises(ValueError):
        chat.Escaper(("<a<b>", "<b>"))


def digests(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), chat_hash("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), chat_hash(said))


def chat_hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations(spark):
    want: dict = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op10_chat(spark, SF).collect()}
    assert got == {k: digests(t) for k, t in want.items()}


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "system", None), (2, 1, "user", ""), (2, 2, "assistant", "<|im_end|>\n<|im_start|>user"), (None, 1, None, "x"), (None, None, "we\nird\\n", "y"), (3, 5, "assistant", "alone"), (4, 1, "user", "z"), (4, 1, "user", "a"), (5, 0, "user", "long " * 100_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, position int")
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert {k: r.valid for k, r in out.items()} == {1: False, 2: True, None: False, 3: False, 4: False, 5: True}
    assert out[4].turns_sha256 == digests([("user", "a"), ("user", "z")])[1] and out[None].turns_sha256 == digests([("we\nird\\n", "y"), ("", "x")])[1]
    assert out[2].loss_chars == len(rows[4][3]) and out[3].loss_chars == 5
    first = chat.format_chats(df).where("conv_id = 2 and position = 2").first()
    assert [s.loss for s in first.segments] == [False, True, False]
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0

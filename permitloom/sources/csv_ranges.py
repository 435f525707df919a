"""CSV files read by byte ranges, though quoted fields may hold newlines.

Spark's text source deals a file's lines out by ranges.  Whether a range begins inside a quoted field is known from all
before it, so a first pass takes from each range what it does to either state: two bits a range, which the driver
chains by file.  A second pass cuts each range into its records.  A record that runs over a range's end
leaves a fragment there and one at the start of each range it goes on in; these few rows are joined up by file.

The dialect is that of ``spark.read.csv`` with ``multiLine``, quote and escape both ``"``: a field is quoted if it begins
with a quote, doubled quotes are one, and a quote followed by other text ends the quoting.  In a file whose first line
ends with a carriage return, those before newlines are no part of the text, in quotes or out; empty records are skipped; the first record of each file has the names, and those of
the first file count; longer rows are cut, shorter ones filled with nulls.  Bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permitloom.operators.scratch import stored

_IN_QUOTES = re.compile('(?:[^"]+|"")*')
WHOLE, HEAD, TAIL = 0, 1, 2
_RECORDS = "file string, start long, seq long, kind int, record string"


def after_line(line: str, inside: bool) -> bool:
    """Whether the text after a line is inside a quoted field, if the line begins inside one or not."""
    at = 0
    while True:
        if not inside:
            if line.startswith('"', at):
                at += 1
                inside = True
                continue
        else:
            at = _IN_QUOTES.match(line, at).end()
            if at == len(line):
                return True
            inside = False
        at = line.find(",", at) + 1
        if not at:
            return False


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the range), value: the lines of each range, in order."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.make_valid_utf8("value").alias("value"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """Runs of lines of one range."""
    for batch in batches:
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        first = 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or starts[k] != starts[first] or files[k] != files[first]:
                yield files[first], starts[first], batch.column("value").slice(first, k - first)
                first = k


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, start, whether a range ends inside a field, after an outer beginning and after an inner one, and whether its first line ends with a carriage return."""
    found: dict[tuple[str, int], tuple[bool, bool]] = {}
    returns: dict[tuple[str, int], bool] = {}
    for file, start, lines in _by_range(batches):
        outer, inner = found.get((file, start), (False, True))
        returns.setdefault((file, start), lines[0].as_py().endswith("\r"))
        for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():  # other lines change nothing
            outer, inner = after_line(line, outer), after_line(line, inner)
        found[file, start] = (outer, inner)
    if found:
        yield pa.RecordBatch.from_pydict({"file": [f for f, _ in found], "start": [s for _, s in found], "outer": [o for o, _ in found.values()], "inner": [i for _, i in found.values()], "returns": [*returns.values()]})


def _cut(begins: dict[tuple[str, int], bool], returns: set[str]) -> Callable:
    """Records and fragments of each range; ``seq`` counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, inside, head, seq, held = None, False, False, 0, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["file", "start", "seq", "kind", "record"])

        def ended() -> list[tuple]:
            return [(*present, seq, HEAD if head else TAIL if inside else WHOLE, "\n".join(held))] if held else []

        for file, start, lines in _by_range(batches):
            rows = []
            if (file, start) != present:
                rows += ended() if present else []
                present, seq, held = (file, start), 0, []
                inside = head = begins[present]
            if file in returns:
                lines = pc.replace_substring_regex(lines, r"\r$", "")  # noqa: PLW2901
            quoted = pc.match_substring(lines, '"').to_pylist()
            for line, q in zip(lines.to_pylist(), quoted, strict=True):
                held.append(line)
                if q:
                    inside = after_line(line, inside)
                if not inside:
                    rows.append((file, start, seq, HEAD if head else WHOLE, "\n".join(held) if len(held) > 1 else line))
                    seq, held, head = seq + 1, [], False
            if rows:
                yield out(rows)
        if present and (rows := ended()):
            yield out(rows)

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, start, seq (which order the records of a file), record (its text): from a table that ``forget`` deletes."""
    lines = lines_of(spark, path)
    begins, state, returns = {}, {}, set()
    for r in sorted(lines.mapInArrow(_effects, "file string, start long, outer boolean, inner boolean, returns boolean").collect()):  # a row for each range
        begins[r.file, r.start] = state.get(r.file, False)
        if r.returns and r.file not in state:
            returns.add(r.file)
        state[r.file] = r.inner if begins[r.file, r.start] else r.outer
    cut = stored(lines.mapInArrow(_cut(begins, returns), _RECORDS), "records")
    # At most one of either kind for each range.  A tail begins a record, heads go on with it.
    order = Window.partitionBy("file").orderBy("start", "seq")
    parts = cut.where(F.col("kind") != WHOLE).withColumn("of", F.count_if(F.col("kind") == TAIL).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p["record"]), "\n")
    joined = parts.groupBy("file", "of").agg(F.min(F.struct("start", "seq")).alias("at"), text.alias("record")).select("file", "at.start", "at.seq", "record")
    rows = cut.where(F.col("kind") == WHOLE).drop("kind").unionByName(joined)
    rows = rows.where("record != ''")
    rows.scratch_path = cut.scratch_path
    return rows


def column_names(record: str) -> list[str]:
    """The names in a header; nameless columns are _c and their place, and names that come twice get their place too."""
    names = [n or f"_c{k}" for k, n in enumerate(next(csv.reader(io.StringIO(record, newline=""))))]
    return [f"{n}{k}" if names.count(n) > 1 else n for k, n in enumerate(names)]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder with headers, all text, in the order of the files, in as many tasks as its bytes ask for.

    ``forget`` deletes the table it reads.
    """
    rows = records(spark, path)
    heads = rows.groupBy("file").agg(F.min(F.struct("start", "seq", "record")).alias("head")).select("file", "head.*")
    first = heads.orderBy("file").first()
    if first is None:
        out = spark.createDataFrame([], "")
    else:
        names = column_names(first.record)
        fields = F.from_csv("record", ", ".join(f"c{k} string" for k in range(len(names))), {"quote": '"', "escape": '"'})
        body = rows.join(F.broadcast(heads.drop("record")), ["file", "start", "seq"], "left_anti")  # a row for each file
        out = body.orderBy("file", "start", "seq").select(fields.alias("r")).select("r.*").toDF(*names)
    out.scratch_path = rows.scratch_path
    return out

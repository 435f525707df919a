"""Chat formatting by a declarative template and a finite-state machine over roles.

A template states the text before and after a turn, which roles may follow which, and whose
texts count for the loss.  The machine runs over a conversation's turns in order and emits
each one's text segments with a loss flag per segment.  A turn whose role has no transition
from the present state makes the conversation invalid from there on (``in_order`` false); it
is formatted all the same, so no text is lost, and a caller may filter on the flag.

A conversation's rows come to one task sorted, and stream through it: what is held is the
machine's state, not the conversation, so its length has no bound.

Control strings inside a turn's text are escaped: their first character is followed by a mark
(U+2060); where the text has such marks there already, one more.  An escaped text holds
no control string, and taking one mark off each such place gives the text back exactly.

Rows with a null conversation id form one conversation; null turns come first; rows of equal
turn are ordered by role and text, and repeated rows are turns each; a null role is the empty
role; null and empty texts are empty turns; a long text is one turn, held by itself.  An empty
table has no conversations.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitloom.llm.common import string

START = "start"
MARK = "⁠"


@dataclass(frozen=True)
class Template:
    """A turn is before + role + between + text + after; follows: state (the last role) -> roles that may come next."""

    before: str
    between: str
    after: str
    follows: dict[str, tuple[str, ...]]
    loss: tuple[str, ...]
    #: Besides before and after: strings of other templates that texts must not pass on.
    controls: tuple[str, ...]

    def all_controls(self) -> tuple[str, ...]:
        return tuple(sorted({self.before.strip(), self.after.strip(), *self.controls}))


#: Roles system, user, assistant; the loss is on what the assistant says.
TURNS = Template(
    before="<|im_start|>",
    between="\n",
    after="<|im_end|>\n",
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    loss=("assistant",),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"),
)


class Escaper:
    """Keeps control strings out of texts, reversibly."""

    def __init__(self, controls: tuple[str, ...]):
        heads = "".join(sorted({re.escape(x[0]) for x in controls}))
        rests = "|".join(re.escape(x[1:]) for x in controls)
        self._into = re.compile(f"([{heads}]{MARK}*)(?={rests})")
        self._out = re.compile(f"([{heads}]{MARK}*){MARK}(?={rests})")
        if any(len(x) < 2 or self._into.search(x, 1) for x in controls):
            raise ValueError("a control string must have two characters or more and not hold the start of another")

    def escape(self, text: str) -> str:
        return self._into.sub(rf"\1{MARK}", text)

    def unescape(self, text: str) -> str:
        return self._out.sub(r"\1", text)


def _role(role: str) -> str:
    """A role as it stands in a header: on one line."""
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _unrole(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def segments(template: Template, escaper: Escaper, role: str, text: str) -> list[dict]:
    """The segments of one turn."""
    return [
        {"text": template.before + escaper.escape(_role(role)) + template.between, "loss": False},
        {"text": escaper.escape(text), "loss": role in template.loss},
        {"text": template.after, "loss": False},
    ]


def parse(template: Template, escaper: Escaper, formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted string, from the string alone."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(template.before, at):
            raise ValueError("a turn must start with the template's mark")
        at += len(template.before)
        middle = formatted.index(template.between, at)
        end = formatted.index(template.after, middle + len(template.between))
        turns.append((_unrole(escaper.unescape(formatted[at:middle])), escaper.unescape(formatted[middle + len(template.between) : end])))
        at = end + len(template.after)
    return turns


_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_chats(df: DataFrame, template: Template = TURNS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per turn: ``conv``, position (from 0), segments (text, loss), in_order (so far)."""
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["conv"].dataType.simpleString()
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper = Escaper(template.all_controls())
        state, position, in_order, present = START, 0, True, object()
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                out = []
                for c, r, t in zip(batch.column("conv").to_pylist(), *(string(batch.column(k)).to_pylist() for k in ("role", "text")), strict=True):
                    if c != present:
                        state, position, in_order, present = START, 0, True, c
                    in_order = in_order and r in template.follows.get(state, ())
                    out.append((position, segments(template, escaper, r, t), in_order))
                    state, position = r, position + 1
                p, s, o = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(p, pa.int64()), pa.array(s, _SEGMENTS), pa.array(o, pa.bool_())], names=["conv", "position", "segments", "in_order"])

    return rows.mapInArrow(run, f"conv {kind}, position long, segments array<struct<text:string,loss:boolean>>, in_order boolean").withColumnRenamed("conv", conv)


def read_back(formatted: DataFrame, template: Template = TURNS, conv: str = "conv_id") -> DataFrame:
    """From the segments: per conversation n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid.

    Turns are parsed from the segments' joined text; the text under the mask comes from the flags.
    """
    rows = formatted.select(F.col(conv).alias("conv"), "position", "segments", "in_order").repartition("conv").sortWithinPartitions("conv", "position")
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper = Escaper(template.all_controls())
        present, began, out = None, False, []
        n = loss_chars = chars = 0
        valid = True
        turns_hash = loss_hash = None

        def done():
            out.append((present, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars, valid))

        def emit(field):
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], field), *(pa.array(c) for c in columns[1:])], names=names)

        for batch in batches:
            field = batch.schema.field("conv").type
            for c, parts, ok in zip(*(batch.column(k).to_pylist() for k in ("conv", "segments", "in_order")), strict=True):
                if not began or c != present:
                    if began:
                        done()
                    present, began, n, loss_chars, chars, valid = c, True, 0, 0, 0, True
                    turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                joined = "".join(p["text"] for p in parts)
                for role, text in parse(template, escaper, joined):
                    turns_hash.update(f"{role}\n{text}\n".encode())
                    n += 1
                for p in parts:
                    if p["loss"]:
                        text = escaper.unescape(p["text"])
                        loss_hash.update(text.encode())
                        loss_chars += len(text)
                chars += len(joined)
                valid = valid and ok
            if len(out) > 2000:
                yield emit(field)
        if began:
            done()
            yield emit(field)

    return rows.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean").withColumnRenamed("conv", conv)

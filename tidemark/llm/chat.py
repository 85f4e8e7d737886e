"""Conversations as training text, rendered by a compiled template, with marks for the loss.

The template is compiled to closures once in each worker. Rows are dealt by ranges of
(conversation, turn) and rendered in segments of a bounded number of turns, so a
conversation that holds a large share of all rows is spread over many tasks. A segment holds whole
turns, and the segments of a conversation, in order, are its formatted text.

Texts may hold the template's control strings. ``escape`` puts a backslash behind the first
character of each of them and doubles backslashes, so that no control string is left in a
text and :func:`unescape` restores it.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import staged
from tidemark.llm.template import Loop, Output, Template, TemplateError, _run, as_text, compile_template, names_in

# Fixed strings of the format.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]")
TEMPLATE = """
{%- for m in messages -%}
{%- if m.role == 'user' -%}{{ '<s>[INST] ' ~ m.text | escape ~ ' [/INST]' }}
{%- elif m.role == 'assistant' -%}{{ ' ' }}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>
{%- elif m.role == 'system' -%}<<SYS>>{{ m.text | escape }}<</SYS>>
{%- else -%}[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}[END]
{%- endif -%}
{%- endfor -%}
"""
SEGMENT_TURNS = 256
SEGMENT_CHARS = 1 << 20
# What a task keeps of a conversation that may go on in the next one.
PENDING_CHARS = 8 << 20
SEGMENT_DDL = (
    "conv_id long, part int, segment long, n_turns long, text string, "
    "loss array<struct<start:bigint,stop:bigint>>"
)
SUMMARY_DDL = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
_STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + r").|\\", re.DOTALL)
_TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?)</s>|<<SYS>>(?P<system>.*?)<</SYS>>"
    r"|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)\[END\]",
    re.DOTALL,
)


def escape(value) -> str:
    return _STARTS.sub(lambda m: m[0] + "\\", as_text(value))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@lru_cache(maxsize=16)
def compiled(source: str) -> Template:
    return compile_template(source, ("messages",), {"escape": escape})


@lru_cache(maxsize=16)
def turn_writer(source: str):
    """The closure for one turn of a template that is a loop over the turns and nothing else.

    Only such templates can be rendered in segments: the text of a turn may depend on that turn alone.
    """
    template = compiled(source)
    if len(template.body) != 1 or not isinstance(template.body[0], Loop):
        raise TemplateError("a template rendered in segments is one loop over the messages")
    loop = template.body[0]
    if names_in(loop.over) != {"messages"} or names_in(loop.body) & {"messages", "loop"}:
        raise TemplateError("a template rendered in segments reads one turn at a time")
    return loop.name, _run(loop.body, template.filters)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Role and text of every turn of formatted text in the format of ``TEMPLATE``."""
    turns, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if found is None:
            raise ValueError(f"no turn begins at {at}: {text[at : at + 20]!r}")
        if found["role"] is not None:
            turns.append((unescape(found["role"]), unescape(found["text"])))
        else:
            turns.append((found.lastgroup, unescape(found[found.lastgroup])))
        at = found.end()
    return turns


class _Segment:
    """Turns rendered so far."""

    def __init__(self):
        self.out, self.turns = Output(), 0

    def row(self, conv_id, part: int, number: int) -> dict:
        spans = [{"start": a, "stop": b} for a, b in self.out.spans]
        text = "".join(self.out.parts)
        return dict(conv_id=conv_id, part=part, segment=number, n_turns=self.turns, text=text, loss=spans)


def _segments(batches, source: str, most_turns: int = SEGMENT_TURNS):
    """Segments of sorted turns, in batches."""
    name, write = turn_writer(source)
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("part", pa.int32()),
            ("segment", pa.int64()),
            ("n_turns", pa.int64()),
            ("text", pa.string()),
            ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ]
    )
    context = TaskContext.get()
    part = context.partitionId() if context is not None else 0
    segment, conv, number = _Segment(), None, 0
    for batch in batches:
        rows = []
        columns = (batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))
        for conv_id, role, text in zip(*columns, strict=True):
            full = segment.turns == most_turns or segment.out.length >= SEGMENT_CHARS
            if segment.turns and (conv_id != conv or full):
                rows.append(segment.row(conv, part, number))
                segment, number = _Segment(), number + 1
            conv = conv_id
            write({name: {"role": role, "text": text}}, segment.out)
            segment.turns += 1
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    if segment.turns:
        yield pa.RecordBatch.from_pylist([segment.row(conv, part, number)], schema)


def format_conversations(turns: DataFrame, source: str = TEMPLATE, most_turns: int = SEGMENT_TURNS) -> DataFrame:
    """``conv_id, part, segment, n_turns, text, loss`` for the rows of ``turns(conv_id, turn, role, text)``.

    The segments of a conversation in the order of ``part`` and ``segment`` are its text; ``loss`` has the
    ranges of code points of ``text`` that a generation block wrote.

    Turns are in the order of ``turn``, nulls first; turns of one number in that of role and text. Repeated
    rows are turns of their own. A null text or role is empty. Rows without a ``conv_id`` are a
    conversation of their own. Other columns are ignored; without rows the result is empty.
    """
    turn_writer(source)
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn"),
        *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")),
        # Repeated rows may be split, too.
        F.monotonically_increasing_id().alias("read_at"),
    )
    placed = rows.repartitionByRange(*order, "read_at").sortWithinPartitions(*order, "read_at")
    said = placed.select("conv_id", "role", "text")
    return said.mapInArrow(lambda batches: _segments(batches, source, most_turns), SEGMENT_DDL)


def whole_conversations(segments: DataFrame) -> DataFrame:
    """``conv_id, n_turns, text, loss`` with the segments of each conversation joined.

    For conversations that fit in one value, 2 GB at most; ``loss`` counts from the text's first code point.
    """
    ordered = segments.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("part", "segment", "text", "loss"))).alias("s"),
    )
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")

    def add(acc, s):
        def move(x):
            return F.struct(*((x[end] + acc["at"]).alias(end) for end in ("start", "stop")))

        loss = F.concat(acc["loss"], F.transform(s["loss"], move))
        return F.struct((acc["at"] + F.char_length(s["text"])).alias("at"), loss.alias("loss"))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("loss"))
    moved = F.aggregate("s", start, add, lambda acc: acc["loss"])
    return ordered.select("conv_id", "n_turns", F.concat_ws("", F.col("s.text")).alias("text"), moved.alias("loss"))


class _Summary:
    """What is read back from the segments of one conversation, in order."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[dict]) -> None:
        for role, said in read_turns(text):
            self.all.update(f"{role}\n{said}\n".encode())
            self.turns += 1
        for span in spans:
            said = unescape(text[span["start"] : span["stop"]])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(text)

    def row(self) -> dict:
        return dict(
            conv_id=self.conv_id,
            n_turns=self.turns,
            turns_sha256=self.all.hexdigest(),
            loss_chars=self.loss_chars,
            loss_sha256=self.loss.hexdigest(),
            formatted_chars=self.chars,
        )


def _read_back(batches, most_pending: int = PENDING_CHARS):
    """Summaries of conversations that begin and end in this task, and the segments of the others.

    The first and the last conversation of a task may go on in another one. Of the current one
    a bounded part is kept; a longer one is handed on as segments, too.
    """
    first, current, kept, size = True, None, [], 0
    for batch in batches:
        rows = []
        for s in batch.to_pylist():
            if current is None or s["conv_id"] != current.conv_id:
                if current is not None and kept is not None:
                    rows += kept if first else [current.row()]
                first = first and current is None
                current, kept, size = _Summary(s["conv_id"]), [], 0
            if kept is None:
                rows.append(s)
                continue
            kept.append(s)
            size += len(s["text"])
            if size > most_pending:
                rows, kept = rows + kept, None
            elif not first:
                current.add(s["text"], s["loss"])
        yield from _mixed(rows)
    if kept:
        yield from _mixed(kept)


_MIXED = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int32()),
        ("segment", pa.int64()),
        ("text", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)
_MIXED_DDL = (
    "conv_id long, part int, segment long, text string, loss array<struct<start:bigint,stop:bigint>>, "
    "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _mixed(rows: list[dict]):
    if rows:
        yield pa.RecordBatch.from_pylist([{name: r.get(name) for name in _MIXED.names} for r in rows], _MIXED)


def _streamed(batches):
    """Summaries of conversations whose segments come in order, whole conversations to a task."""
    current = None
    schema = pa.schema([f for f in _MIXED if f.name not in ("part", "segment", "text", "loss")])
    for batch in batches:
        done = []
        for s in batch.to_pylist():
            if current is None or s["conv_id"] != current.conv_id:
                if current is not None:
                    done.append(current.row())
                current = _Summary(s["conv_id"])
            current.add(s["text"], s["loss"])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if current is not None:
        yield pa.RecordBatch.from_pylist([current.row()], schema)


def read_back(segments: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of formatted conversations.

    ``segments`` comes straight from :func:`format_conversations`. Turns are parsed from the text and
    unescaped. A digest runs over a whole conversation; the task that makes it streams the segments.
    """
    mixed = staged(segments.mapInArrow(_read_back, _MIXED_DDL), "read-back")
    columns = [c.split()[0] for c in SUMMARY_DDL.split(", ")]
    parts = mixed.where("text is not null").select("conv_id", "part", "segment", "text", "loss")
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment")
    return mixed.where("text is null").select(*columns).unionByName(parts.mapInArrow(_streamed, SUMMARY_DDL))


def marked_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: two turns that say control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )

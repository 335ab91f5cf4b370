"""Chat formatting by event-sourced reconstruction.

An event log is folded per message (streamed deltas joined in sequence, an edit replaces what came
before, a regeneration discards it, a deletion removes the message), messages are put in order per
conversation, and each turn is rendered with escaped control strings. The loss mask covers exactly
the assistant texts.

Scale: the fold deals events by message, so a hot conversation's events spread over many tasks, and
streams each message's events in order, holding its text only. Rendering
needs a conversation in order and streams it: a worker holds one part (``part_chars``), never a
whole conversation; longer conversations continue in further parts.

Defined cases: null text is empty, null role is the empty role, null conversation is a conversation
of its own, equal sequence numbers are ordered by kind, text and role, repeated messages all stay.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Event kinds: ``delta`` appends text, ``edit`` sets it, ``regenerate`` clears it, ``delete`` removes the message.
KINDS = ("delta", "edit", "regenerate", "delete")


@dataclass(frozen=True)
class Template:
    """Turn marks. Every mark must begin with ``<`` or ``[``, end with ``>`` or ``]``, and hold neither ``\\`` nor those elsewhere."""

    turn_open: str = "<s>"
    turn_close: str = "</s>"
    ask_open: str = "[INST]"
    ask_close: str = "[/INST]"

    @property
    def marks(self) -> tuple[str, ...]:
        return self.turn_open, self.turn_close, self.ask_open, self.ask_close

    def escape(self, text: str) -> str:
        """Text in which no mark occurs: a backslash goes into each mark and before each backslash."""
        return re.sub("|".join(map(re.escape, ("\\", *self.marks))), lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn, and where its escaped text stands in it."""
        head = self.turn_open + self.escape(role).replace("\n", "\\\n") + "\n"
        head, tail = (head, self.turn_close) if role == "assistant" else (head + self.ask_open, self.ask_close + self.turn_close)
        body = self.escape(text)
        return head + body + tail, len(head), len(head) + len(body)

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Role and text of each turn."""
        o, c, a, z = map(re.escape, self.marks)
        for m in re.finditer(rf"{o}((?:[^\\\n]|\\.)*)\n(?:{a}(.*?){z}|(.*?)){c}", formatted, flags=re.S):
            yield self.unescape(m[1]), self.unescape(m[2] if m[2] is not None else m[3])


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_id, first_seq, role, text) of a log (conv_id, message_id, seq, kind, role, text).

    ``seq`` may have any orderable type. Unknown or null kinds count as ``delta``. Events are sorted and
    folded as they come: a task holds what one message says, not its log.
    """
    columns = ["conv_id", "message_id", "seq", "kind", "text", "role"]
    types = {f.name: f.dataType for f in events.schema.fields}
    out = StructType([StructField(n, types[m]) for n, m in (("conv_id", "conv_id"), ("message_id", "message_id"), ("first_seq", "seq"))] + [StructField("role", StringType()), StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, said, role, kind = None, None, [], None, None

        def close() -> list:
            return [] if row is None or kind == "delete" else [(*row, role or "", "".join(said))]

        for batch in batches:
            done = []
            for *key, seq, event, text, by in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if row is None or key != now:
                    done += close()
                    now, row, said, role = key, (*key, seq), [], None
                kind = event
                role = by if role is None else role
                if event in ("edit", "regenerate"):
                    said = []
                if event not in ("regenerate", "delete"):
                    said.append(text or "")
            if done:
                yield messages(done, batch.schema)
            schema = batch.schema
        if close():
            yield messages(close(), schema)

    def messages(rows: list, schema: pa.Schema) -> pa.RecordBatch:
        kinds = [schema.field(c).type for c in columns[:3]] + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], out.names)

    return events.select(*columns).repartition("conv_id", "message_id").sortWithinPartitions(*columns).mapInArrow(run, out)


def table_events(conversations: DataFrame) -> DataFrame:
    """The event log of a table of finished turns: each row opens a message and streams its text in two deltas."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("message_id"))
    parts = F.array(F.struct(F.lit(0).alias("part"), F.col("text").substr(F.lit(1), half).alias("said")), F.struct(F.lit(1).alias("part"), F.col("text").substr(half + 1, F.length("text")).alias("said")))
    return rows.select("conv_id", "turn", "role", "message_id", F.inline(parts)).select("conv_id", "message_id", F.struct("turn", "part").alias("seq"), F.lit("delta").alias("kind"), "role", F.col("said").alias("text"))


RENDERED = "conv_id long, part long, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>"


def render_conversations(messages: DataFrame, template: Template | None = None, part_chars: int = 1 << 20) -> DataFrame:
    """Formatted conversations with loss spans (code point ranges in ``formatted``), in parts of about ``part_chars``.

    Rows come out ordered by conversation and part within each partition, a conversation in one partition.
    """
    form = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, part, pieces, spans, held = none, 0, [], [], 0

        def out() -> pa.RecordBatch:
            row = {"conv_id": conv, "part": part, "n_turns": len(pieces), "formatted": "".join(pieces), "loss_spans": spans}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

        ready: list[pa.RecordBatch] = []
        for batch in batches:
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if pieces and (c != conv or held >= part_chars):
                    ready.append(out())
                    part, pieces, spans, held = (part + 1 if c == conv else 0), [], [], 0
                if c != conv:
                    conv, part = c, 0
                piece, start, end = form.render(role or "", text or "")
                if role == "assistant":
                    spans.append({"start": held + start, "end": held + end})
                pieces.append(piece)
                held += len(piece)
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                ready = []
        if pieces:
            yield out()

    ordered = messages.select(F.col("conv_id").cast("long").alias("conv_id"), "first_seq", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "first_seq", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, RENDERED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(rendered: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of turns and masked texts, parsed from rendered rows in the order ``render_conversations`` gives."""
    form = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        rows: list[tuple] = []

        def close() -> None:
            if state:
                rows.append((conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])

        for batch in batches:
            for c, part, formatted, spans in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "part", "formatted", "loss_spans")), strict=True):
                if part == 0:
                    close()
                    conv, state = c, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                for role, text in form.parse(formatted):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = form.unescape(formatted[span["start"] : span["end"]])
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
                state["all"] += len(formatted)
            if rows:
                yield out()
        close()
        if rows:
            yield out()

    return rendered.mapInArrow(run, DIGEST)


def format_log(events: DataFrame, template: Template | None = None) -> DataFrame:
    """From an event log to rendered conversations."""
    return render_conversations(fold_events(events), template)


def oracle(table: str = "conversations") -> str:
    """DuckDB SQL for the digests of a table of turns and conversation -1, in the standard template."""
    # Each mark and each backslash takes one character more when it is escaped, as does a line feed of a role.
    marks = r"\\|<s>|</s>|\[INST\]|\[/INST\]"
    longer = lambda x, p: f"(length({x}) + length(regexp_replace({x}, '({p})', '\\1.', 'g')) - length({x}))"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {table}
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s></s>') + 1 + {longer('role', marks + '|' + chr(92) + 'n')} + {longer('text', marks)} + CASE WHEN role = 'assistant' THEN 0 ELSE length('[INST][/INST]') END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, with all turns before it as
context and only its text trainable.

A conversation is written once, as a stream of formatted turns. An example is a prefix of that stream: it runs from 0 to the
end of its reply, and its loss mask is the span of the reply's text. Spans count code points of the stream. Written out, a
conversation of n turns has n * n / 2 turns of context; as spans it has n, so a conversation of any length stays linear.
`example_texts` writes examples out for training.

Template: `<s>role\\ntext</s>` per turn. A control string inside a text gets a backslash behind its first character, one more
than it already has there, and reading back takes one away, so no text can end a turn and every text returns unchanged.
Roles hide line breaks and backslashes as well.

Turns are range-partitioned by conversation and turn; each task numbers its rows, and what a conversation has in earlier
tasks is added afterwards. Only the first conversation of a task can have begun before it, so that table has at most one row
per task and is broadcast. A conversation with a third of all rows is spread like any other.

Defined cases: a null text or role is empty; rows without conv_id form one conversation; a null turn comes first. Turns with
equal numbers are ordered by a hash of role and text, repeated rows each count. A conversation that does not end in an
assistant turn (also one without any) has one more example, of all its turns and with an empty loss mask. An empty table
has no examples. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from echotide.llm.common import store

BEGIN, SPLIT, END = "<s>", "\n", "</s>"
ASSISTANT = "assistant"
#: Control strings of public chat templates and tokenizers. None overlaps another.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_TAILS = {opener: "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == opener) for opener in "<["}
_AHEAD = {opener: rf"(?=\\*(?:{tails}))" for opener, tails in _TAILS.items()}
ESCAPE = "|".join(re.escape(opener) + ahead for opener, ahead in _AHEAD.items())
_ESCAPED = re.compile("|".join(rf"(?<={re.escape(opener)})\\{ahead}" for opener, ahead in _AHEAD.items()))
SALTS = 64

TURNS = "conv_id long, position long, role string, formatted string, start long, loss_start long, loss_end long, end long"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$0\\")


def unescaped(text: str) -> str:
    return _ESCAPED.sub("", text)


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    role, text = formatted[len(BEGIN):-len(END)].split(SPLIT, 1)
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)
    return unescaped(role), unescaped(text)


def turns(conversations: DataFrame) -> DataFrame:
    """The stream: one formatted turn a row, with its place in its conversation. Stored in the shared folder."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.concat(F.lit(BEGIN), escaped_role(role), F.lit(SPLIT)).alias("head"), escaped(text).alias("body"),
        F.xxhash64(role, text).alias("tie"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
    keys = ("conv_id", "turn", "tie", "salt")
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        F.spark_partition_id().alias("part"), "conv_id", "role", F.length("head").alias("head_chars"),
        F.length("body").alias("body_chars"), F.concat("head", "body", F.lit(END)).alias("formatted"))
    local = store(ranged.mapInArrow(_numbered, f"part int, {TURNS}"), "chat_turns")
    return _continued(local)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions and offsets within the rows of one task, which come in order."""
    conv, position, offset, first = None, 0, 0, True
    for batch in batches:
        row = batch.to_pydict()
        columns = {c: [] for c in ("position", "start", "loss_start", "loss_end", "end")}
        for conv_id, head, body in zip(row["conv_id"], row["head_chars"], row["body_chars"]):
            if first or conv_id != conv:
                conv, position, offset, first = conv_id, 0, 0, False
            loss = offset + head
            for name, value in zip(columns, (position, offset, loss, loss + body, loss + body + len(END))):
                columns[name].append(value)
            position, offset = position + 1, columns["end"][-1]
        numbers = {c: pa.array(v, pa.int64()) for c, v in columns.items()}
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), batch.column("conv_id"), numbers["position"], batch.column("role"), batch.column("formatted"),
             numbers["start"], numbers["loss_start"], numbers["loss_end"], numbers["end"]],
            ["part", "conv_id", "position", "role", "formatted", "start", "loss_start", "loss_end", "end"])


def _continued(local: DataFrame) -> DataFrame:
    """Add what each conversation has in the tasks before: at most one conversation a task has anything."""
    held = local.groupBy("conv_id", "part").agg((F.max("position") + 1).alias("rows"), F.max("end").alias("chars"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.sum("rows").over(before).alias("rows"),
                          F.sum("chars").over(before).alias("chars")).where("rows is not null")
    joined = local.join(F.broadcast(carried), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    rows, chars = (F.coalesce(c, F.lit(0)) for c in ("rows", "chars"))
    moved = {"position": rows, "start": chars, "loss_start": chars, "loss_end": chars, "end": chars}
    names = [field.split()[0] for field in TURNS.split(", ")]
    return joined.select(*[(F.col(c) + moved[c]).alias(c) if c in moved else F.col(c) for c in names])


def examples(stream: DataFrame) -> DataFrame:
    """One row per example: its text is the stream of its conversation from 0 to `end`, its loss mask [loss_start, loss_end)."""
    spans = ("position", "loss_start", "loss_end", "end")
    replies = stream.where(F.col("role") == ASSISTANT).select("conv_id", *spans)
    last = stream.groupBy("conv_id").agg(F.max_by(F.struct("role", "position", "end"), "position").alias("last"))
    rest = last.where(F.col("last.role") != ASSISTANT).select(
        "conv_id", "last.position", F.col("last.end").alias("loss_start"), F.col("last.end").alias("loss_end"), "last.end")
    return replies.unionByName(rest)


def _in_order(stream: DataFrame, found: DataFrame) -> DataFrame:
    """Turns and examples of each conversation as one sorted run; an example follows the last turn that it holds."""
    rows = stream.select("conv_id", "position", F.lit(0).alias("kind"), "start", "loss_start", "loss_end", "end", "formatted")
    marks = found.select("conv_id", "position", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("start"), "loss_start",
                         "loss_end", "end", F.lit(None).cast("string").alias("formatted"))
    return rows.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "position", "kind")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def example_texts(stream: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, example (position of its last turn), text, loss_start, loss_end: examples written out, whole contexts included."""

    def write(batches):
        conv, parts, first = None, [], True
        for row in _rows(batches):
            if first or row["conv_id"] != conv:
                conv, parts, first = row["conv_id"], [], False
            if row["kind"] == 0:
                parts.append(row["formatted"])
            else:
                yield pa.RecordBatch.from_pylist([{
                    "conv_id": conv, "example": row["position"], "text": "".join(parts), "loss_start": row["loss_start"],
                    "loss_end": row["loss_end"]}], schema)

    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()),
                        ("loss_end", pa.int64())])
    return _in_order(stream, found).mapInArrow(write, "conv_id long, example long, text string, loss_start long, loss_end long")


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(stream: DataFrame, found: DataFrame) -> DataFrame:
    """What a reader of stream and examples sees, one row per conversation: turns and trainable text as digests, which need
    each conversation in order, and the code points of all its examples. Rows stream through; only one turn is held."""

    def digest(batches):
        conv, state, turn = None, None, None
        for row in _rows(batches):
            if state is None or row["conv_id"] != conv:
                if state is not None:
                    yield _digest_row(conv, state)
                conv, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            if row["kind"] == 0:
                turn = row
                role, text = parse_turn(row["formatted"])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            else:
                trained = unescaped(turn["formatted"][row["loss_start"] - turn["start"]:row["loss_end"] - turn["start"]])
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[4] += row["end"]
        if state is not None:
            yield _digest_row(conv, state)

    return _in_order(stream, found).mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_row(conv: int | None, state: list) -> pa.RecordBatch:
    n, turns_hash, loss, loss_hash, chars = state
    values = (conv, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars)
    return pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, values))], DIGEST)

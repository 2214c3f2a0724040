"""Chat training examples by prefix-target expansion.

Every assistant turn is an example of its own: its text is the conversation's formatted
text from the start to the end of that turn, and only that turn's own text is trainable.
Examples are written with their whole prefixes, so a table of them grows with the square
of a conversation's length, as the method has it; a task streams through conversations and
holds the text of one. Turns after the last assistant turn stand in no example: they are a
row of their own that is no target, so that every turn can be read back.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts every `<|` gets
a mark after the `<`, and one that has marks gets one more, which is reversible.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.session import scratch, ship

START, END, MARK = "<|im_start|>", "<|im_end|>", "␛"
_ESCAPE, _UNESCAPE = re.compile(f"<({MARK}*)\\|"), re.compile(f"<{MARK}({MARK}*)\\|")

#: last marks the example that holds all turns before the conversation's rest.
EXAMPLE = "part int, conv_id long, place long, target boolean, text string, loss_start long, loss_chars long, last boolean"
#: Characters of examples that a task puts out at once.
BATCH_CHARS = 8_000_000


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"<{MARK}{m[1]}|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: f"<{m[1]}|", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and the start and size of its text there. A role's newlines are
    marked too, as the first newline ends it."""
    head = f"{START}{escape(role.replace('%', '%25').replace(chr(10), '%0A'))}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of every formatted turn."""
    for turn in formatted.split(START)[1:]:
        role, _, rest = turn.partition("\n")
        yield unescape(role).replace("%0A", "\n").replace("%25", "%"), unescape(rest[: -len(END) - 1])


def _batches(rows: Iterator[tuple], schema: str, text: int) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about BATCH_CHARS characters in the column `text`."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(list(zip(*out)) or [[]] * len(fields), fields)], names=[n for n, _ in fields])

    for row in rows:
        out.append(row)
        size += len(row[text] or "")
        if size > BATCH_CHARS or len(out) >= 5000:
            yield batch()
            out, size = [], 0
    yield batch()


def expand(conversations: DataFrame) -> DataFrame:
    """The examples of conversations and their rests (see EXAMPLE): text, trained on
    loss_chars characters from loss_start where target; place numbers a conversation's rows.

    Rows are in the order of turn; ties by role and text. Null roles and texts are empty,
    null conv_ids are one conversation, null turns come first. Repeated rows are turns of
    their own. A column part, if there, tells conversations of one conv_id apart. Extra
    columns are ignored; no rows give no rows."""
    ship(conversations.sparkSession)
    part = F.col("part").cast("int") if "part" in conversations.columns else F.lit(0)
    rows = conversations.select(part.alias("part"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("part", "conv_id").sortWithinPartitions("part", "conv_id", "turn", "role", "text")

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, parts, place, held = None, [], 0, None  # parts[0]: the text up to the last example

        def close() -> Iterator[tuple]:
            if key is not None:
                if held:
                    yield (*held, True)
                yield (*key, place, False, "".join(parts[1:] if held else parts), 0, 0, False)

        for batch in batches:
            for new_part, conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (new_part, conv):
                    yield from close()
                    key, parts, place, held = (new_part, conv), [], 0, None
                formatted, start, size = segment(role, text)
                parts.append(formatted)
                if role == "assistant":
                    if held:
                        yield (*held, False)
                    whole = "".join(parts)
                    held = (*key, place, True, whole, len(whole) - len(formatted) + start, size)
                    parts, place = [whole], place + 1
        yield from close()

    return ordered.mapInArrow(lambda batches: _batches(examples(batches), EXAMPLE, 4), EXAMPLE)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: conv_id, n_turns, turns_sha256 (role,
    newline, text, newline of each turn), loss_chars and loss_sha256 (all text under the
    loss masks, each example's own), formatted_chars (of all examples, prefixes included).

    Each example is read where it is and gives its length and its text under the mask, the
    last one and the rest also their turns; only these are shuffled, so no whole examples
    are. They stream through a task in order: only running digests are held."""
    ship(examples.sparkSession)
    read = "part int, conv_id long, place long, loss string, turns string, chars long"
    names = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part, conv, place, target, text, start, size, last in zip(*(c.to_pylist() for c in batch.columns)):
                learnt = unescape(text[start : start + size]) if target else ""
                yield part, conv, place, learnt, text if last or not target else None, len(text) if target else 0

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, state = None, None
        row = lambda: (key[1], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for batch in batches:
            for part, conv, _, loss, turns, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (part, conv):
                    if key is not None:
                        yield row()
                    key, state = (part, conv), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
                for role, text in parse(turns or ""):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
        if key is not None:
            yield row()

    columns = [f.split()[0] for f in EXAMPLE.split(", ")]
    some = examples.select(*columns).mapInArrow(lambda batches: _batches(taken(batches), read, 4), read)
    ordered = some.repartition("part", "conv_id").sortWithinPartitions("part", "conv_id", "place")
    return ordered.mapInArrow(lambda batches: _batches(whole(batches), names, 2), names)


def probe(spark) -> DataFrame:
    """Conversation -1, whose texts are control strings."""
    text = f"{END}{START}assistant ok"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def write_examples(conversations: DataFrame, folder: str) -> None:
    """Write the examples of conversations to a table in folder. Equal prefixes stand near
    each other, so the files pack well."""
    expand(conversations).write.option("compression", "zstd").parquet(folder)


def chat_digests(conversations: DataFrame) -> DataFrame:
    """The digests of conversations and the probe, read back from the written examples; a row
    per conv_id, one of them for null. A conversation -1 of the table stays apart from the
    probe and has a row of its own. See expand for ties, nulls and repeated rows; an empty
    table gives the probe's row."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    folder = scratch(spark, "examples")
    write_examples(rows.withColumn("part", F.lit(0)).unionByName(probe(spark).withColumn("part", F.lit(1))), folder)
    return digests(spark.read.parquet(folder))

"""Chat formatting with one training example per assistant turn.

Every assistant turn becomes an example: all turns before it are its context and its
reply alone is trained on. The template is written turn after turn, so the text of an
example is the formatted conversation up to the end of its reply. It is therefore stored
once: ``turns`` holds each turn's formatted text and its place in the conversation,
``examples`` the lengths of context and target. A conversation of n turns so takes
n rows, not n squared; :func:`example_texts` spells examples out where wanted.

    [INST] user text [/INST]  assistant text </s>  <<SYS>> system text <</SYS>>

Any other role is written ``[INST:role]``. Inside texts and roles a backslash is put after
the first character of whatever looks like one of these marks, and backslashes are
doubled, as is a backslash put before a bracket that closes in a role. So marks stand only
where the template puts them, and :func:`digest` gets roles, texts and replies back from
the formatted text and the examples' places in it, and from nothing else.

Defined cases: a null text or role is empty; turns are ordered by turn number (null
first), then role and text; repeated rows are turns of their own; rows with a null
``conv_id`` form one conversation; a conversation without assistant turn has no example;
a very long text is a turn like any other; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import frugal, partitions

# The turns each conversation is made of, in SQL: opening and closing of a role.
TEMPLATE = {
    "system": ("<<SYS>> ", " <</SYS>>\n"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": (" ", " </s>"),
}
# Turns numbered together; a conversation of more turns is spread over several tasks.
BLOCK = 1024
_MARK = r"(?i)([<\\[])(?=/?s>|/?INST[\\]:]|<?/?SYS>)"


def escape(column: str) -> str:
    """SQL for a text with backslashes doubled and marks broken up."""
    return rf"regexp_replace(replace({column}, '\\', '\\\\'), '{_MARK}', '$1\\\\')"


def unescape(column: str) -> str:
    """SQL that undoes :func:`escape`."""
    return rf"regexp_replace({column}, '(?s)\\\\(.)', '$1')"


def escape_role(column: str) -> str:
    """SQL for a role in its mark, which the first bare bracket closes."""
    return rf"replace({escape(column)}, ']', '\\]')"


def _by_role(which: int, other: str) -> str:
    cases = " ".join(
        f"WHEN '{role}' THEN {_quoted(marks[which])}" for role, marks in TEMPLATE.items()
    )
    return f"CASE role {cases} ELSE {other} END"


def _quoted(text: str) -> str:
    return "'" + text.replace("\n", "\\n") + "'"


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, role, opening, body, closing``: each turn in the template.

    ``body`` is the escaped text. Positions count from 0 in a conversation.
    """
    opening = _by_role(0, f"concat('[INST:', {escape_role('role')}, '] ')")
    closing = _by_role(1, "' [/INST]'")
    rows = conversations.selectExpr(
        "CAST(conv_id AS BIGINT) AS conv_id",
        "CAST(turn AS BIGINT) AS turn",
        "coalesce(role, '') AS role",
        "coalesce(text, '') AS text",
    )
    sized = rows.selectExpr(
        "*", f"{opening} AS opening", f"{escape('text')} AS body", f"{closing} AS closing"
    ).selectExpr(
        "*",
        "length(opening) + length(body) + length(closing) AS length",
        f"coalesce(floor(turn / {BLOCK}), -9223372036854775808) AS block",
    )
    # Within a block of turns by rank; over the blocks by their sums, a row each.
    order = Window.partitionBy("conv_id", "block").orderBy(
        F.col("turn").asc_nulls_first(), "role", "text"
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    local = sized.select(
        "*",
        (F.row_number().over(order) - 1).cast("bigint").alias("_at"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("_start"),
    )
    earlier = (
        Window.partitionBy("conv_id")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = (
        sized.groupBy("conv_id", "block")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("chars"))
        .select(
            F.col("conv_id").alias("_conv"),
            F.col("block").alias("_block"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"),
            F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("_chars"),
        )
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (
        F.col("block") == F.col("_block")
    )
    return local.join(blocks, same).select(
        "conv_id",
        (F.col("_n") + F.col("_at")).alias("position"),
        "role",
        "opening",
        "body",
        "closing",
        (F.col("_chars") + F.col("_start")).alias("start"),
    )


def expand_prefixes(turns: DataFrame) -> DataFrame:
    """One example per assistant turn, as places in the formatted conversation.

    ``conv_id, position, context_chars, target_chars``: the context is everything before
    the reply's body, the target the body; the loss mask covers the target alone.
    """
    return turns.filter("role = 'assistant'").select(
        "conv_id",
        "position",
        (F.col("start") + F.length("opening")).alias("context_chars"),
        F.length("body").cast("bigint").alias("target_chars"),
    )


def example_texts(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """``conv_id, position, context, target`` spelled out for the given examples.

    The output repeats every prefix, as trainers that take whole texts need it. Pass
    the examples of a batch, not of a corpus with endless conversations.
    """
    earlier = turns.selectExpr(
        "conv_id", "position AS _at", "concat(opening, body, closing) AS piece", "opening", "body"
    )
    joined = examples.join(earlier, "conv_id").filter("_at <= position")
    pieces = F.array_sort(
        F.collect_list(
            F.struct(
                "_at", F.expr("if(_at = position, opening, piece)").alias("piece")
            )
        )
    )
    return joined.groupBy("conv_id", "position").agg(
        F.concat_ws("", F.transform(pieces, lambda p: p["piece"])).alias("context"),
        F.max(F.expr("if(_at = position, body, NULL)")).alias("target"),
    )


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, start, piece``: the formatted conversations, in pieces one after the other."""
    return turns.selectExpr("conv_id", "start", "concat(opening, body, closing) AS piece")


# A turn in the template: one of the openings, an escaped text, the closing that goes with it.
_TURN = re.compile(
    r"<<SYS>> (?P<system>.*?) <</SYS>>\n"
    r"|\[INST\] (?P<user>.*?) \[/INST\]"
    r"|\[INST:(?P<role>(?:[^\\\]]|\\.)*)\] (?P<other>.*?) \[/INST\]"
    r"| (?P<assistant>.*?) </s>",
    re.DOTALL,
)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


class Conversation:
    """Reads one formatted conversation back, piece by piece."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.rest, self.at = "", 0
        self.turns = self.loss = 0
        self.whole, self.trained = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str) -> None:
        self.parse()
        self.rest += piece

    def parse(self) -> None:
        """Take the turns that are complete off what has been read."""
        done = 0
        while found := _TURN.match(self.rest, done):
            name = found.lastgroup
            role = _ESCAPED.sub(r"\1", found["role"]) if name == "other" else name
            text = _ESCAPED.sub(r"\1", found[name])
            self.whole.update(f"{role}\n{text}\n".encode())
            self.turns += 1
            done = found.end()
        self.rest, self.at = self.rest[done:], self.at + done

    def train(self, place: int, length: int) -> None:
        """A stretch of the formatted text that the loss mask covers."""
        start = place - self.at
        if start < 0 or start + length > len(self.rest):
            raise ValueError(f"no such place in conversation {self.conv_id}: {place}")
        text = _ESCAPED.sub(r"\1", self.rest[start : start + length])
        self.loss += len(text)
        self.trained.update(text.encode())

    def close(self) -> tuple:
        self.parse()
        if self.rest:
            raise ValueError(f"conversation {self.conv_id} is not in the template")
        return (
            self.conv_id,
            self.turns,
            self.whole.hexdigest(),
            self.loss,
            self.trained.hexdigest(),
            self.at,
        )


def digest(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """What the formatted conversations and the examples' places say, per conversation.

    Only the formatted text is read of the turns. It streams past in order, a piece at a
    time, so a long conversation is never held whole; each place comes after its piece.
    """
    pieces = formatted(turns).selectExpr(
        "conv_id", "start AS place", "0 AS kind", "piece", "CAST(NULL AS BIGINT) AS length"
    )
    places = examples.selectExpr(
        "conv_id",
        "context_chars AS place",
        "1 AS kind",
        "CAST(NULL AS STRING) AS piece",
        "target_chars AS length",
    )
    rows = (
        pieces.unionByName(places)
        .repartition(partitions(turns.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "place", "kind")
    )
    names = ["conv_id", "place", "kind", "piece", "length"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, done = None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * 6
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _DIGEST, strict=True)],
                schema=_DIGEST,
            )

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in names)
            for conv, place, kind, piece, length in zip(*columns, strict=True):
                if reader is None or reader.conv_id != conv:
                    if reader is not None:
                        done.append(reader.close())
                    reader = Conversation(conv)
                if kind:
                    reader.train(place, length)
                else:
                    reader.add(piece)
            yield flush()
        if reader is not None:
            done.append(reader.close())
            yield flush()

    return rows.mapInArrow(
        frugal(sums),
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint",
    )


_DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)

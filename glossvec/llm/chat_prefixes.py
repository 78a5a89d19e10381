r"""Prefix-target expansion of conversations: every assistant turn is an example of its own.

An example is the formatted conversation up to and including one assistant turn,
of which only that reply is trainable. The template is stable under prefixes: a
turn is formatted alone, and a conversation is its turns end to end. All examples
of a conversation are therefore prefixes of one text, and `expand_prefixes` says
where an example's context ends and its reply lies, beside the turn that completes
it: that table grows with the turns, not with their square. `written_examples`
writes every prefix out as a text, one after the other where a conversation's turns
stream by; `render_examples` is the table of them, and `conversation_digests`
reads each of them back.

A turn is `### role:\n text \n</turn>\n`. Inside role and text a backslash, `<` and
`#` (in a role also `:`) become a backslash and a letter, so no text can hold
a mark of the template, and reading back is exact.

Defined results: a null text or role is empty; turns are ordered by turn (null
first), then role, then text, and repeated turns all stay; null conversation ids
form one conversation; an empty table gives an empty result; extra columns are
not carried over.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET = "assistant"
HEAD, MIDDLE, TAIL = "### ", ":\n", "\n</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))

#: Turn numbers that are summed up in one task; a longer conversation is spread over several.
BLOCK = 1024
_NO_TURN = -(1 << 62)


def escape(text: Column, table=ESCAPES) -> Column:
    for plain, code in table:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), escape(role, ROLE_ESCAPES), F.lit(MIDDLE), escape(text), F.lit(TAIL))


def expand_prefixes(turns: DataFrame, target: str = TARGET) -> DataFrame:
    """One row per turn of (conv_id, turn, role, text), in its conversation's formatted text.

    position, formatted, start (characters before it); and where the turn is a
    target, its example: example (number), context_turns, target_start and
    target_chars, counted from the beginning of the conversation. The context is
    all characters before target_start. Others have null there.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("__block", F.coalesce(F.floor(F.col("turn") / BLOCK).cast("bigint"), F.lit(_NO_TURN)))
    rows = rows.withColumn("formatted", format_turn(F.col("role"), F.col("text"))).withColumn("__len", F.length("formatted").cast("bigint"))
    rows = rows.withColumn("__hit", (F.col("role") == target).cast("bigint"))
    inside = Window.partitionBy("conv_id", "__block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)

    def running(c, over):
        return F.coalesce(F.sum(c).over(over), F.lit(0).cast("bigint"))

    placed = rows.select(
        "*", (F.row_number().over(inside) - 1).cast("bigint").alias("__p"), running("__len", before).alias("__s"), running("__hit", before).alias("__e"))
    blocks = rows.groupBy("conv_id", "__block").agg(F.count("*").alias("n"), F.sum("__len").alias("len"), F.sum("__hit").alias("hit"))
    up = Window.partitionBy("conv_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(
        F.col("conv_id").alias("__c"), F.col("__block").alias("__b"), running("n", up).alias("__n0"), running("len", up).alias("__len0"), running("hit", up).alias("__hit0"))
    met = placed.join(bases, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__block") == F.col("__b")))
    start, hit = F.col("__len0") + F.col("__s"), F.col("__hit") == 1
    head = F.lit(len(HEAD) + len(MIDDLE)) + F.length(escape(F.col("role"), ROLE_ESCAPES))
    return met.select(
        "conv_id", "turn", (F.col("__n0") + F.col("__p")).alias("position"), "formatted", start.alias("start"),
        F.when(hit, F.col("__hit0") + F.col("__e")).alias("example"),
        F.when(hit, F.col("__n0") + F.col("__p")).alias("context_turns"),
        F.when(hit, start + head).alias("target_start"),
        F.when(hit, F.length(escape(F.col("text"))).cast("bigint")).alias("target_chars"),
    )


#: Characters of written examples in a batch.
WRITTEN_AT_A_TIME = 8 << 20
_PIECES = ("conv_id", "example", "formatted", "target_start", "target_chars")


def _in_order(expanded: DataFrame) -> DataFrame:
    # The id is hashed as it is, so that a null one has a place too.
    return expanded.select("conv_id", "position", *_PIECES[1:]).repartition("conv_id").sortWithinPartitions("conv_id", "position")


def written_examples(batches):
    """Every example written out, of turns sorted by conversation and position: (conv_id, example, text, target_start, target_chars).

    After the examples of a conversation comes its whole text, which has no target
    (nulls). One text is held, whatever the number of examples.
    """
    conv, text, any_turn = None, "", False
    for batch in batches:
        for c, example, formatted, start, chars in zip(*[batch.column(n).to_pylist() for n in _PIECES]):
            if any_turn and c != conv:
                yield conv, None, text, None, None
                text = ""
            conv, any_turn = c, True
            text += formatted
            if example is not None:
                yield conv, example, text, start, chars
    if any_turn:
        yield conv, None, text, None, None


def _render(batches):
    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("target_start", pa.int64()), ("target_chars", pa.int64())])
    held, size = [], 0
    for row in written_examples(batches):
        if row[1] is None:
            continue
        held.append(row)
        size += len(row[2])
        if size >= WRITTEN_AT_A_TIME:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def render_examples(expanded: DataFrame) -> DataFrame:
    """(conv_id, example, text, target_start, target_chars): every example written out.

    The result holds each turn once for every later reply, which is what prefixes
    written out are; a conversation's turns are shuffled once, and its examples are
    written one after the other.
    """
    return _in_order(expanded).mapInArrow(_render, "conv_id bigint, example bigint, text string, target_start bigint, target_chars bigint")


def _plain(text: str, table=ESCAPES) -> str:
    """Every backslash of an escaped text begins a code, so codes are found one kind after the other; the backslash is last."""
    for plain, code in reversed(table):
        text = text.replace(code, plain)
    return text


class _Reader:
    """Reads one conversation's examples: turns by the marks of the template, replies by the spans of the loss masks.

    `read` takes whole examples, `feed` text as it streams by.
    """

    def __init__(self, conv_id):
        self.row = {"conv_id": conv_id, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_examples": 0, "expanded_chars": 0}
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.rest, self.at, self.spans, self.known = "", 0, deque(), ""

    def read(self, text: str, start: int | None, chars: int | None) -> None:
        """An example, or the whole conversation, which begins with every example read before and ends with a turn."""
        if not text.startswith(self.known):
            raise ValueError(f"conversation {self.row['conv_id']}: an example does not begin as the one before")
        self.feed(text[len(self.known) :], start, chars)
        if self.at != len(text) or self.spans or (start is not None and start + chars + len(TAIL) != len(text)):
            raise ValueError(f"conversation {self.row['conv_id']}: an example does not end with its reply")
        self.known = text

    def feed(self, formatted: str, start: int | None, chars: int | None) -> None:
        self.rest += formatted
        if start is not None:
            self.spans.append((start, chars))
        while (end := self.rest.find(TAIL)) >= 0:
            middle = self.rest.find(MIDDLE)
            if not self.rest.startswith(HEAD) or not 0 <= middle < end:
                raise ValueError(f"conversation {self.row['conv_id']}: no turn begins at character {self.at}")
            role, text = self.rest[len(HEAD) : middle], self.rest[middle + len(MIDDLE) : end]
            self.turns.update(f"{_plain(role, ROLE_ESCAPES)}\n{_plain(text)}\n".encode())
            self.row["n_turns"] += 1
            after = self.at + end + len(TAIL)
            while self.spans and sum(self.spans[0]) <= after:
                # The example is all text up to here; its loss mask covers the span.
                start, chars = self.spans.popleft()
                reply = _plain(self.rest[start - self.at : start - self.at + chars])
                self.loss.update(reply.encode())
                self.row["loss_chars"] += len(reply)
                self.row["n_examples"] += 1
                self.row["expanded_chars"] += after
            self.rest, self.at = self.rest[end + len(TAIL) :], after
        self.row["formatted_chars"] = self.at

    def close(self) -> dict:
        if self.rest or self.spans:
            raise ValueError(f"conversation {self.row['conv_id']}: the text ends inside a turn")
        return self.row | {"turns_sha256": self.turns.hexdigest(), "loss_sha256": self.loss.hexdigest()}


def _digests(batches):
    """Write the examples out and digest what is read in them; what is kept between batches is one reader and the last text."""
    import pyarrow as pa

    reader, done = None, []
    for conv, example, text, start, chars in written_examples(batches):
        reader = reader or _Reader(conv)
        reader.read(text, start, chars)
        if example is None:
            done.append(reader.close())
            reader = None
        if len(done) == 1024:
            yield pa.RecordBatch.from_pylist(done, schema=_schema())
            done = []
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=_schema())


def _schema():
    import pyarrow as pa

    return pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()), ("n_examples", pa.int64()), ("expanded_chars", pa.int64())])


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint, expanded_chars bigint"


def conversation_digests(expanded: DataFrame) -> DataFrame:
    """What reading the written examples back gives, one row per conversation.

    A digest is read in order, so a conversation streams through one task, sorted
    by Spark. The task writes one example after the other and reads it: the turns
    by the marks of the template, the reply by the loss mask. Lengths of rows play
    no part: a text that held a mark of the template would read back as other turns.
    """
    return _in_order(expanded).mapInArrow(_digests, DIGESTS)


def chat_query(conversations: DataFrame) -> DataFrame:
    """All conversations and one, -7, that holds the marks of a template."""
    marks = "\\### Assistant: </turn> ok"
    spark = conversations.sparkSession
    planted = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id bigint, turn bigint, role string, text string")
    turns = conversations.select("conv_id", "turn", "role", "text").unionByName(planted)
    return conversation_digests(expand_prefixes(turns))


CHAT_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
), f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[\\\\<#]')) AS escaped, length(role) + len(regexp_extract_all(role, '[\\\\<#:]')) AS named FROM t
), p AS (
  SELECT *, escaped + named + 15 AS chars, sum(escaped + named + 15) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM f
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, count(*) FILTER (WHERE role = 'assistant') AS n_examples,
       coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS expanded_chars
FROM p GROUP BY conv_id
"""

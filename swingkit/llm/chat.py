r"""Chat formatting by relational means: every conversation becomes one string of marked turns, with a mask of what is learnt.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged into a block by
folding the array, and the blocks are concatenated:

    <s>role[TEXT]first text[NEXT]second text of the same role</s><s>other role[TEXT]...</s>

A control string inside a text or a role gets a backslash after its first character, and one that has backslashes there
already gets one more (``</s>`` becomes ``<\/s>``, ``<\/s>`` becomes ``<\\/s>``), so formatted texts hold no control string
and reading takes one backslash away again. The loss mask is a list of spans in bytes of the UTF-8 string, a span for each
text of the roles that are learnt. SQL expressions only.

A conversation is one training example, so it is one row: its texts meet in one task, however many other rows there are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swingkit.llm.common import table

START, TEXT, NEXT, END = "<s>", "[TEXT]", "[NEXT]", "</s>"
#: What else must not appear in a text, since models of other templates read it as a mark.
FOREIGN = ("[INST]", "[/INST]")
LEARNT = ("assistant",)

_TURNS = "array<struct<turn: bigint, role: string, text: string>>"


def _marks(foreign: Sequence[str]) -> list[str]:
    marks = [START, TEXT, NEXT, END, *foreign]
    if any(len(m) < 2 or "\\" in m or any(m[0] in other[1:] for other in marks) for m in marks):
        raise ValueError("a control string has two characters or more, no backslash, and its first character nowhere but in front")
    return marks


def escaped(text: Column, foreign: Sequence[str] = FOREIGN) -> Column:
    """``text`` with one more backslash after the first character of every control string, whether it has some or none."""
    found = "|".join(rf"{_quoted(m[0])}(?=\\*+{_quoted(m[1:])})" for m in _marks(foreign))
    return F.regexp_replace(text, F.lit(found), F.lit(r"$0\\"))


def unescaped(text: Column, foreign: Sequence[str] = FOREIGN) -> Column:
    """The inverse of :func:`escaped`."""
    marks = _marks(foreign)
    found = "|".join(rf"({_quoted(m[0])})\\(?=\\*+{_quoted(m[1:])})" for m in marks)
    return F.regexp_replace(text, F.lit(found), F.lit("".join(f"${k + 1}" for k in range(len(marks)))))


def _quoted(mark: str) -> str:
    return re.escape(mark)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id`` and ``turns``, sorted by turn, role and text with null turns first.

    Null roles and texts count as empty. Rows of a null conversation are one conversation. Repeated rows are repeated
    turns. Other columns are left out.
    """
    one = F.struct(F.col(turn).cast("bigint").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).cast(_TURNS).alias("turns"))


def blocks(turns: Column) -> Column:
    """The turns as blocks: ``role`` and ``texts`` of each run of turns of one role."""
    begun = F.aggregate(
        turns,
        F.struct(F.array().cast("array<int>").alias("starts"), F.lit(None).cast("string").alias("role"), F.lit(1).alias("at")),
        lambda acc, t: F.struct(
            F.when(acc["role"].eqNullSafe(t["role"]), acc["starts"]).otherwise(F.array_append(acc["starts"], acc["at"])).alias("starts"), t["role"].alias("role"), (acc["at"] + 1).alias("at")
        ),
    )

    def cut(known: Column) -> Column:
        def block(start: Column, k: Column) -> Column:
            upto = F.coalesce(F.get(known["starts"], k + 1), F.size(known["turns"]) + 1)
            own = F.slice(known["turns"], start, upto - start)
            return F.struct(F.get(own, F.lit(0))["role"].alias("role"), F.transform(own, lambda t: t["text"]).alias("texts"))

        return F.transform(known["starts"], block)

    return _let(F.struct(turns.alias("turns"), begun["starts"].alias("starts")), cut)


def format_chats(rows: DataFrame, learnt: Sequence[str] = LEARNT, foreign: Sequence[str] = FOREIGN, **names: str) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans``, an array of ``start`` and ``length`` in bytes from 0. ``names``: see :func:`conversations`."""
    own = conversations(rows, **names).select("conv_id", blocks(F.col("turns")).alias("blocks"))

    def pieces(block: Column) -> Column:
        """The strings of a block, and which of them are learnt."""
        masked = block["role"].isin(*learnt) if learnt else F.lit(False)
        plain = lambda s: F.struct(s.alias("s"), F.lit(False).alias("loss"))
        head = plain(F.concat(F.lit(START), escaped(block["role"], foreign), F.lit(TEXT)))
        body = F.transform(
            block["texts"], lambda t, k: F.array(plain(F.when(k > 0, F.lit(NEXT)).otherwise(F.lit(""))), F.struct(escaped(t, foreign).alias("s"), F.coalesce(masked, F.lit(False)).alias("loss")))
        )
        return F.concat(F.array(head), F.flatten(body), F.array(plain(F.lit(END))))

    def output(parts: Column) -> Column:
        spans = F.aggregate(
            parts,
            F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans")),
            lambda acc, p: F.struct(
                (acc["at"] + F.octet_length(p["s"])).alias("at"),
                F.when(p["loss"], F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), F.octet_length(p["s"]).cast("bigint").alias("length")))).otherwise(acc["spans"]).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )
        return F.struct(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))

    made = own.select("conv_id", _let(F.flatten(F.transform("blocks", pieces)), output).alias("made"))
    return made.select("conv_id", "made.formatted", "made.loss_spans")


def read_turns(formatted: Column, foreign: Sequence[str] = FOREIGN) -> Column:
    """The turns (``role``, ``text``) that a formatted string holds."""
    parts = F.filter(F.split(formatted, _quoted(END)), lambda b: b != "")

    def turns(block: Column) -> Column:
        def of(halves: Column) -> Column:
            role = F.get(halves, F.lit(0)).substr(F.lit(len(START) + 1), F.length(F.get(halves, F.lit(0))))
            texts = F.split(F.get(halves, F.lit(1)), _quoted(NEXT))
            return _let(unescaped(role, foreign), lambda r: F.transform(texts, lambda t: F.struct(r.alias("role"), unescaped(t, foreign).alias("text"))))

        return _let(F.split(block, _quoted(TEXT)), of)

    return F.flatten(F.transform(parts, turns))


def read_loss(formatted: Column, spans: Column, foreign: Sequence[str] = FOREIGN) -> Column:
    """The texts under the mask, unescaped, in order."""
    known = F.struct(formatted.cast("binary").alias("bytes"), spans.alias("spans"))
    under = lambda x: F.transform(x["spans"], lambda s: unescaped(F.substring(x["bytes"], s["start"].cast("int") + 1, s["length"].cast("int")).cast("string"), foreign))
    return _let(known, under)


def op12_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -1, formatted and read back; empty tables give conversation -1 alone."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = format_chats(rows.unionByName(own))
    read = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"regexp_replace({}, '(<)(\\*/?s>)|(\[)(\\*(?:TEXT|NEXT|/?INST)\])', '\1\3\\\2\4', 'g')"

ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) <> role, true) AS begins FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format('text')})) + sum(CASE WHEN begins THEN length({_ESCAPED.format('role')}) + 13 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

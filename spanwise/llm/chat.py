"""Conversations as training text: one string a conversation with its turns marked, and a loss mask.

A conversation's rows are collected as structs and sorted; neighbours of the same role
are merged into one turn by array functions, and all is concatenated. Everything is a
Spark expression::

    <turn user>
    first text<turn/>second text</turn>
    <turn assistant>
    answer</turn>

``<turn/>`` parts the rows of a merged turn. Control strings begin with ``<turn`` or
``</turn``; where a text holds one, with any number of backslashes after its ``<``, one
backslash more is put there, and one less is read back. So no control string is ever
left in a text, other texts stay as they are, and the text that comes back is the text
that went in. In a role ``%``, ``<``, ``>`` and line feeds are percent-encoded.

The mask is run-length coded: a run (``chars``, ``loss``) for each mark and each text
in order, in code points. Losses are counted on the texts of the roles that are
learnt, without any mark.

Every step is linear in a conversation's length: ends of turns are found by comparing
neighbours, as an array that is appended to in a fold would be copied at every step.
A conversation is one row of the result, so what it holds must fit one row (2 GB);
conversations, however many, share no task beyond that.

Defined cases: null text and null role are empty; rows of equal ``turn`` are ordered by
role and text, rows without one come first; rows that repeat are all kept; rows
without ``conv_id`` are one conversation; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of a turn's first line and of a turn, and what parts rows of a merged turn.
HEAD, END, NEXT = ">\n", "</turn>\n", "<turn/>"
OPEN = "<turn "
#: Roles whose texts are learnt.
LEARNT = ("assistant",)


def escaped(text: Column) -> Column:
    """``text`` without control strings; others than those that look like one are unchanged."""
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def named(role: Column) -> Column:
    """A role as the first line of a turn holds it."""
    for c in "%<>\n":
        role = F.replace(role, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return role


def unnamed(role: Column) -> Column:
    for c in "\n><%":
        role = F.replace(role, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return role


def collected(rows: DataFrame) -> DataFrame:
    """``conv_id, rows``: each conversation's rows in order, as structs of ``turn, role, text``."""
    kept = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("row"))
    return kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))


def merged(rows: Column) -> Column:
    """Turns as structs of ``role`` and ``texts``: neighbours of one role are one turn."""
    n = F.size(rows)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (rows[i]["role"] != rows[F.greatest(i - 1, F.lit(0))]["role"]))
    ends = F.concat(F.slice(starts, 2, n), F.array(n))
    spans = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(spans, lambda s: F.struct(rows[s["a"]]["role"].alias("role"), F.transform(F.slice(rows, s["a"] + 1, s["b"] - s["a"]), lambda r: r["text"]).alias("texts")))


def _run(chars: Column, loss: Column) -> Column:
    return F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))


def format_conversations(rows: DataFrame, learnt: tuple[str, ...] = LEARNT) -> DataFrame:
    """``conv_id, formatted, mask`` of conversations (``conv_id, turn, role, text``)."""
    turns = collected(rows).select("conv_id", merged(F.col("rows")).alias("turns"))
    marked = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), named(t["role"]), F.lit(HEAD)).alias("head"), F.transform(t["texts"], escaped).alias("texts"), t["role"].isin(*learnt).alias("loss"))).alias("turns"),
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], F.array_join(t["texts"], NEXT), F.lit(END))), "")
    no = F.lit(False)

    def runs(t: Column) -> Column:
        each = F.flatten(F.transform(t["texts"], lambda x, i: F.array(_run(F.when(i == 0, F.length(t["head"])).otherwise(len(NEXT)), no), _run(F.length(x), t["loss"]))))
        return F.concat(each, F.array(_run(F.lit(len(END)), no)))

    return marked.select("conv_id", text.alias("formatted"), F.flatten(F.transform("turns", runs)).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, rows, loss, formatted_chars``: the rows (``role, text``) that the text holds, and the texts under the mask.

    A mask whose runs are not those of the text raises an error.
    """
    blocks = F.split("formatted", END, -1)
    whole = formatted.select("conv_id", "mask", F.length("formatted").alias("formatted_chars"), F.slice(blocks, 1, F.size(blocks) - 1).alias("blocks"))
    parted = whole.select("conv_id", "mask", "formatted_chars", F.transform("blocks", lambda b: F.struct(F.substring_index(b, HEAD, 1).alias("head"), b.alias("block"))).alias("blocks"))
    turns = parted.select(
        "conv_id",
        "mask",
        "formatted_chars",
        F.transform("blocks", lambda b: F.struct(b["head"].alias("head"), F.split(F.substr(b["block"], F.length(b["head"]) + len(HEAD) + 1), NEXT, -1).alias("texts"))).alias("turns"),
    )
    none = F.lit(None).cast("string")

    def pieces(t: Column) -> Column:
        # as the runs of the mask: a mark, a text, ..., the end; a mark has its length only
        each = F.flatten(F.transform(t["texts"], lambda x, i: F.array(F.struct(F.when(i == 0, F.length(t["head"]) + len(HEAD)).otherwise(len(NEXT)).alias("chars"), none.alias("text")), F.struct(F.length(x).alias("chars"), x.alias("text")))))
        return F.concat(each, F.array(F.struct(F.lit(len(END)).alias("chars"), none.alias("text"))))

    def under(piece: Column, run: Column) -> Column:
        fits = F.coalesce((piece["chars"] == run["chars"]) & ~(run["loss"] & piece["text"].isNull()), F.lit(False))
        return F.when(~fits, F.raise_error(F.lit("the mask's runs are not those of the text")).cast("string")).when(run["loss"], unescaped(piece["text"]))

    rows = F.flatten(F.transform("turns", lambda t: F.transform(t["texts"], lambda x: F.struct(unnamed(F.substr(t["head"], F.lit(len(OPEN) + 1))).alias("role"), unescaped(x).alias("text")))))
    laid = turns.select("conv_id", "mask", "formatted_chars", rows.alias("rows"), F.flatten(F.transform("turns", pieces)).alias("pieces"))
    return laid.select("conv_id", "rows", F.filter(F.zip_with("pieces", "mask", under), lambda x: x.isNotNull()).alias("loss"), "formatted_chars")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what :func:`read_back` finds: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``; a turn is a row of the conversation."""
    back = read_back(formatted)
    lines = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), "")
    told = back.select("conv_id", F.size("rows").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.array_join("loss", "").alias("loss"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
    return told.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: The conversation that :func:`with_probe` adds: its texts look like control strings of templates.
PROBE, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def with_probe(rows: DataFrame) -> DataFrame:
    """``rows`` and conversation -7: a user's and an assistant's row that say the same."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = rows.sparkSession.range(2).select(F.lit(PROBE).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(own)


#: The digest straight from the rows: what must come back, and the length that the template gives.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), near AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS first, lead(role) OVER w IS DISTINCT FROM role AS last
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g'))
    + CASE WHEN first THEN 8 + length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E'), chr(10), '%0A')) ELSE 7 END
    + CASE WHEN last THEN 8 ELSE 0 END AS chars FROM near
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

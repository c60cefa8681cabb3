r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written as `<turn ROLE>`, a line feed, its text, `</turn>` and a line feed. In texts every `<turn` or `</turn`
gets a backslash behind its `<` (and one more where backslashes stand there already), so that markers occur only where
the template puts them; in roles `%`, `>` and the line feed are percent-encoded. Both are undone exactly on reading.
Every assistant turn becomes an example: all turns before it as context, then the turn itself, of which only the text is
trainable, as a span of code points. Turns after the last assistant turn would be in no example, so a conversation that
ends in another role has one more example without a trainable span. A conversation is one row when it is formatted: its
turns must fit a task's memory; examples leave one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import let, tidy

_END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\(/?turn)", r"<$1$2")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(">"), F.lit("%3E")), F.lit("\n"), F.lit("%0A"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3E"), F.lit(">")), F.lit("%25"), F.lit("%"))


def examples(turns: DataFrame) -> DataFrame:
    """Training examples of conversations.

    Takes conv_id, turn, role and text, a row per turn; other columns are not read. Turns are ordered by turn (null
    first), then role, then text, and repeated rows are turns of their own; null roles and texts are empty; turns with a
    null conv_id form one conversation. Returns conv_id, example (from 0), last (of its conversation), formatted,
    loss_start and loss_chars (code points from 0; a null start where nothing is trainable). No turns give no rows.
    """
    t = tidy(turns, "conv_id", "turn", "role", "text").fillna("", ["role", "text"])
    head = F.concat(F.lit("<turn "), _role_out(F.col("role")), F.lit(">\n"))
    body = escape(F.col("text"))
    one = F.struct("turn", "role", head.alias("head"), body.alias("body"))
    convs = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    places = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (F.get("turns", i)["role"] == "assistant") | (i == F.size("turns") - 1))
    placed = convs.select("conv_id", "turns", F.size(places).alias("n"), F.posexplode(places).alias("example", "place"))
    before = F.concat_ws("", F.transform(F.slice("turns", F.lit(1), F.col("place")), _written))
    this = F.get("turns", F.col("place"))
    out = placed.select("conv_id", "example", (F.col("example") == F.col("n") - 1).alias("last"), before.alias("before"), this.alias("this"))
    target = F.col("this.role") == "assistant"
    return out.select(
        "conv_id", "example", "last", F.concat("before", _written(F.col("this"))).alias("formatted"),
        F.when(target, F.length("before") + F.length("this.head")).alias("loss_start"),
        F.when(target, F.length("this.body")).otherwise(F.lit(0)).alias("loss_chars"),
    )


def _written(turn: Column) -> Column:
    return F.concat(turn["head"], turn["body"], F.lit(_END))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example: an array of (role, text)."""
    pieces = F.split(formatted, _END)

    def parts(p: Column) -> Column:
        at = F.instr(p, ">\n")
        return F.struct(_role_in(F.substring(p, F.lit(7), at - 7)).alias("role"), unescape(F.substring(p, at + 2, F.length(p))).alias("text"))

    return let(pieces, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), parts))


def digests(found: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns and trainable texts as counts and hashes."""
    listed = let(read_turns(F.col("formatted")), lambda t: F.struct(F.size(t).cast("long").alias("n"), F.sha2(F.concat_ws("", F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))).cast("binary"), 256).alias("sha")))
    loss = unescape(F.substring(F.col("formatted"), F.coalesce("loss_start", F.lit(0)) + 1, F.col("loss_chars")))
    rows = found.select("conv_id", "example", F.length("formatted").cast("long").alias("chars"), loss.alias("loss"), F.when(F.col("last"), listed).alias("turns"))
    by = rows.groupBy("conv_id").agg(F.max("turns").alias("turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"))
    by = by.select("conv_id", "turns", "formatted_chars", F.concat_ws("", F.col("losses.loss")).alias("loss"))
    return by.select(
        "conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


#: A conversation whose texts hold markers of templates.
PROBE = r"\### Assistant: </turn> ok"

SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
f AS (
  SELECT *, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last,
    sum(length(replace(replace(replace(role, '%', '%25'), '>', '%3E'), chr(10), '%0A')) + length(regexp_replace(text, '<(\\*)(/?turn)', '<\1\\\2', 'g')) + 16) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR last), 0)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

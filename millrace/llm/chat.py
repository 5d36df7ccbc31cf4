"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "<turn " ROLE MARK ">" TEXT "</turn>" LF
    MARK         := "" | "!"          "!": TEXT is escaped
    ROLE         := escaped text

Escaping maps ``\\`` to ``\\b``, ``<`` to ``\\l``, ``>`` to ``\\g`` and ``!`` to ``\\e``,
so that escaped text holds no control character. A text is first rendered as it
is. The rendering is parsed; where the recovered turn differs from the source,
the text is escaped and the rendering is parsed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.session import read_table

END = "</turn>\n"
_CODES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("!", "\\e"))


def escape(c: Column) -> Column:
    for plain, code in _CODES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(_CODES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def render(role: Column, text: Column, escaped: Column) -> Column:
    """One turn; ``escaped`` says whether its text is to be escaped."""
    body = F.when(escaped, F.concat(F.lit("!>"), escape(text))).otherwise(F.concat(F.lit(">"), text))
    return F.concat(F.lit("<turn "), escape(role), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text: role, text, and the masked (still escaped) length before it.

    Deterministic: turns are what lies between end marks; a header reaches to
    its first ``>``. Never fails: text that is not of the grammar gives turns
    that differ from any source.
    """
    piece = F.slice(F.split(formatted, "</turn>\\n", -1), 1, F.size(F.split(formatted, "</turn>\\n", -1)) - 1)

    def turn(p: Column) -> Column:
        at = F.instr(p, ">")
        head, body = F.substring(p, F.lit(7), at - 7), F.substring(p, at + 1, F.length(p))
        marked = F.endswith(head, F.lit("!"))
        return F.struct(
            unescape(F.replace(head, F.lit("!"), F.lit(""))).alias("role"),
            F.when(marked, unescape(body)).otherwise(body).alias("text"),
            F.length(body).alias("body_chars"), at.alias("header_chars"),
        )

    return F.transform(piece, turn)


def _same(parsed: Column, source: Column) -> Column:
    bare = lambda c: F.transform(c, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return bare(parsed) == bare(source)


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """One row for each conversation: its formatted text, read back.

    Returns ``conv_id, formatted string, turns array<struct<role,text>>`` (read
    back from ``formatted``), ``mask array<struct<start,end>>`` (code points of
    ``formatted`` whose tokens the loss counts: the texts of ``learn``), and
    ``round_trip boolean``, which the escaping makes true.

    Turns are ordered by turn number (null first), then role and text, so that
    ties and repeated rows have one result; null roles and texts are empty;
    rows with a null conversation form one conversation of their own; an empty
    table gives no rows; other columns don't matter. A conversation is one
    text and hence one row; turns are rendered and tested before the shuffle.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    t = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    alone = F.array(F.struct("role", "text"))
    t = t.withColumn("escaped", ~_same(parse(render(F.col("role"), F.col("text"), F.lit(False))), alone))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "escaped"))).alias("source"))
    join = lambda all_: F.array_join(F.transform("source", lambda x: render(x["role"], x["text"], F.lit(True) if all_ else x["escaped"])), "")
    c = c.withColumn("formatted", join(False))
    c = c.withColumn("formatted", F.when(_same(parse(F.col("formatted")), F.col("source")), F.col("formatted")).otherwise(join(True)))
    c = c.withColumn("parsed", parse(F.col("formatted")))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["header_chars"] + x["body_chars"] + len(END)).alias("at"),
        F.when(
            x["role"] == learn,
            F.array_append(acc["spans"], F.struct((acc["at"] + x["header_chars"]).alias("start"), (acc["at"] + x["header_chars"] + x["body_chars"]).alias("end"))),
        ).otherwise(acc["spans"]).alias("spans"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    return c.select(
        "conv_id", "formatted", F.transform("parsed", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"),
        F.aggregate("parsed", zero, step, lambda acc: acc["spans"]).alias("mask"), _same(F.col("parsed"), F.col("source")).alias("round_trip"),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """The text under the mask, unescaped where its turn's header says so."""
    def one(s: Column) -> Column:
        body = F.substring(formatted, s["start"] + 1, s["end"] - s["start"])
        return F.when(F.substring(formatted, s["start"] - 1, F.lit(1)) == "!", unescape(body)).otherwise(body)

    return F.array_join(F.transform(mask, one), "")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 6: all conversations and conversation -7."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    out = format_conversations(rows.unionByName(extra)).withColumn("learned", masked_text(F.col("formatted"), F.col("mask")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "round_trip",
    )


_SPECIAL = "[\\\\<>!]"
_TURN_END = "'</turn>' || chr(10)"
#: DuckDB SQL of the query. A text needs escaping exactly if it holds the end mark.
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
n AS (SELECT *, 15 + length(role) + len(regexp_extract_all(role, '{_SPECIAL}')) + length(text)
  + CASE WHEN contains(text, {_TURN_END}) THEN 1 + len(regexp_extract_all(text, '{_SPECIAL}')) ELSE 0 END AS chars FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned, sum(chars)::BIGINT AS formatted_chars FROM n GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars, true AS round_trip FROM c"""

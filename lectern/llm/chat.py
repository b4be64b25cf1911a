"""Chat formatting with a grammar round trip, in SQL functions alone.

Grammar of a formatted conversation (a turn after the other, nothing between)::

    turn      := "[INST]" role "[:]" text "[/INST]"      any role but assistant: no loss
               | "<s>" text "</s>"                       assistant: loss on text

Control strings inside roles and texts are escaped by one backslash after their first bracket; a sequence that already
looks so gets one more, so unescaping (one less) is exact. Escaping happens only where it is needed: a conversation is
rendered as it is, parsed, and compared turn by turn; if a turn differs, or holds a control string (one that happens to
parse well here might not in another context), it is escaped, rendered and parsed again. What still differs would raise
an error, as the grammar then has a fault.

A conversation is the unit of the result (its digest runs over all its text in order), so its turns meet in one row.

Nulls: null texts and roles are empty; a null turn comes first; rows with a null conv_id form one conversation.
Repeated rows are turns of their own, ordered by (turn, role, text). An empty table gives no row. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A control string, or one that was escaped any number of times.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|:\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|:\])"
TURN = r"(?s)\[INST\](.*?)\[:\](.*?)\[/INST\]|<s>(.*?)</s>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render(turns: Column, escaped: bool) -> Column:
    e = escape if escaped else (lambda c: c)

    def one(t: Column) -> Column:
        return F.when(t["role"] == LOSS_ROLE, F.concat(F.lit("<s>"), e(t["text"]), F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), e(t["role"]), F.lit("[:]"), e(t["text"]), F.lit("[/INST]")))

    return F.concat_ws("", F.transform(turns, one))


def parse(formatted: Column) -> Column:
    """array<struct<role, text, loss>>: what the grammar finds; anything between turns shows as a turn with the role null."""
    whole = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))

    def one(s: Column) -> Column:
        loss = s.startswith("<s>")
        inner = F.when(loss, F.substring(s, F.lit(4), F.length(s) - 7)).otherwise(F.substring(s, F.lit(7), F.length(s) - 13))
        at = F.instr(inner, "[:]")
        return F.struct(
            F.when(loss, F.lit(LOSS_ROLE)).otherwise(unescape(F.substring(inner, F.lit(1), at - 1))).alias("role"),
            unescape(F.when(loss, inner).otherwise(F.substring(inner, at + 3, F.length(inner)))).alias("text"),
            loss.alias("loss"),
        )

    return F.when(F.aggregate(whole, F.lit(0), lambda n, s: n + F.length(s)) == F.length(formatted), F.transform(whole, one))


def same(parsed: Column, turns: Column) -> Column:
    plain = F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.coalesce(plain == F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False))


def conflicts(turns: Column) -> Column:
    return F.exists(turns, lambda t: t["role"].rlike(CONTROL) | t["text"].rlike(CONTROL))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, parsed) of ``rows(conv_id, turn, role, text)``; ``parsed`` is read back from ``formatted``."""
    clean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    convs = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text")), _by_turn).alias("turns"))
    plain = convs.withColumn("plain", render(F.col("turns"), False)).withColumn("formatted", F.when(same(parse(F.col("plain")), F.col("turns")) & ~conflicts(F.col("turns")), F.col("plain")).otherwise(render(F.col("turns"), True)))
    out = plain.select("conv_id", "turns", "formatted", parse(F.col("formatted")).alias("parsed"))
    fault = F.raise_error(F.concat(F.lit("conversation not recovered: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return out.select("conv_id", "formatted", F.when(same(F.col("parsed"), F.col("turns")), F.col("parsed")).otherwise(fault.cast(out.schema["parsed"].dataType)).alias("parsed"))


def _by_turn(a: Column, b: Column) -> Column:
    """Order by turn (null first), role, text."""

    def less(x: Column, y: Column, then: Column) -> Column:
        return F.when(x.eqNullSafe(y), then).when(x.isNull() | (x < y), F.lit(-1)).otherwise(F.lit(1))

    return less(a["turn"], b["turn"], less(a["role"], b["role"], less(a["text"], b["text"], F.lit(0))))


def digests(formatted: DataFrame) -> DataFrame:
    """Columns of the digest query, all from the parsed turns and the formatted text."""
    p = F.col("parsed")
    said = F.concat_ws("", F.transform(p, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform(F.filter(p, lambda t: t["loss"]), lambda t: t["text"]))
    return formatted.select(
        "conv_id", F.size(p).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )

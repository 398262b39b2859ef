"""Chat formatting with Spark expressions only.

The reference records hold no dialogues, so the operator takes any table of
conversations: conv_id, turn, role, text.

A conversation is a string of blocks, one for adjacent turns of one role:
    <s>role[INST]text[/INST]text ... </s>
Strings of the template inside a role or text get a backslash after their
bracket, and such strings that have backslashes there already one more, so that
taking one away restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, HEAD, NEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
GUARD = r"([<\[])(\\*)(/?INST\]|/?s>)"
GUARDED = r"([<\[])\\(\\*)(/?INST\]|/?s>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, GUARD, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, GUARDED, r"$1$2$3")


def format_turns(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): every conversation as one string, and where a model is to learn.

    turns: conv_id, turn, role, text; other columns are left out. Turns are
    sorted by turn, then role, then text; a null turn comes first, a null role or
    text is empty, a null conv_id is a conversation of its own. Repeated rows are
    turns of their own. loss_spans lists the texts of `learn` in order, as
    (block, start, length) in code points of the block (the string split after
    each </s>). An empty table gives none.

    One shuffle on conv_id serves the sort, the running lengths and the
    collected structs. A conversation is one row in the end, so it has to fit in
    a task; every step is linear in it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({"at": F.row_number().over(order), "opens": F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True))})
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lead = F.when(F.col("opens"), F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(HEAD))).otherwise(F.lit(NEXT))
    rows = rows.select("conv_id", "at", "role", "opens", F.sum(F.col("opens").cast("int")).over(so_far).alias("block"), F.length(lead).alias("skip"), F.concat(lead, escaped(F.col("text"))).alias("piece"))
    inside = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.length("piece").cast("long")).over(inside))
    turn = F.struct("at", "block", "role", "opens", "skip", "piece", "end")
    told = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("told"))
    piece = F.transform("told", lambda t: F.concat(F.when(t["opens"] & (t["at"] > 1), F.lit(CLOSE)).otherwise(F.lit("")), t["piece"]))
    spans = F.transform(F.filter("told", lambda t: t["role"] == learn), lambda t: F.struct(
        (t["block"] - 1).cast("int").alias("block"), (t["end"] - F.length(t["piece"]) + t["skip"]).cast("int").alias("start"), (F.length(t["piece"]) - t["skip"]).alias("length")))
    return told.select("conv_id", F.concat(F.array_join(piece, ""), F.lit(CLOSE)).alias("formatted"), spans.alias("loss_spans"))


def blocks(formatted: Column) -> Column:
    return F.split(formatted, CLOSE)


def read_turns(formatted: Column) -> Column:
    """array of (role, text): the turns that a formatted string holds. An empty string has none."""
    full = F.filter(blocks(formatted), lambda b: b != "")

    def turns(block: Column) -> Column:
        begin = F.locate(HEAD, block)
        role = unescaped(F.substring(block, F.lit(len(OPEN) + 1), begin - len(OPEN) - 1))
        body = F.substring(block, begin + len(HEAD), F.lit(2**31 - 1))
        return F.transform(F.split(body, r"\[/INST\]"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(full, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, restored, with nothing between its parts."""
    own = blocks(formatted)
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(F.get(own, s["block"]), s["start"] + 1, s["length"]))), "")

"""Chat formatting with cumulative-snapshot collapse (operator 3).

Method: every turn of a conversation gets a rolling hash of the turns up to it (128 bits: the xor of
two 64-bit hashes of each turn with its place). A conversation whose whole hash is some longer one's
prefix hash at the same length is a snapshot of it: an anti-join keeps the maximal conversations, of
equal ones the one of least id, which are then rendered with a chat template.

Turns are dealt by conversation once, numbered, hashed and rendered there, and written as a row for each
conversation. Prefixes and whole hashes are then compared without texts (a prefix that very many
conversations share is one row after each task's own distinct); of the rendered rows those are taken that stay.

Cases: turns without a conversation id are left out; turns are ordered by turn (null first), role,
text; rows repeated in a conversation count once; null roles and texts differ from empty ones for
the comparison and are rendered as empty; extra columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from siftline.session import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, n (turns), p1, p2 (hash of all of them), prefixes (n, p1, p2 of each shorter beginning) and chat (rendered),
    written. All windows have one partition and order, so rows are moved and sorted once."""
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    own = Window.partitionBy("conv").orderBy("turn", "role", "text")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    again = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lag(c).over(own)) for c in ("turn", "role", "text")], F.row_number().over(own) > 1)
    rows = rows.withColumn("again", again).where(~F.col("again")).withColumn("idx", F.row_number().over(own))
    content = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    rows = rows.withColumns({"p1": F.bit_xor(F.xxhash64("idx", *content)).over(upto), "p2": F.bit_xor(F.xxhash64(F.lit(77), *content, "idx")).over(upto)})
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    t = F.sort_array(F.collect_list(F.struct("idx", "p1", "p2", line.alias("line"))))
    made = rows.groupBy("conv").agg(t.alias("t")).withColumn("whole", F.element_at("t", -1))
    shorter = F.transform(F.slice("t", F.lit(1), F.size("t") - 1), lambda x: F.struct(x["idx"].cast("long").alias("n"), x["p1"].alias("p1"), x["p2"].alias("p2")))
    return cut(made.select("conv", F.col("whole.idx").cast("long").alias("n"), "whole.p1", "whole.p2", shorter.alias("prefixes"), F.array_join("t.line", "").alias("chat")), "conversations")


def collapse(made: DataFrame) -> DataFrame:
    """conv, n_turns, n_logged (equal conversations) of those of :func:`conversations` that are no snapshot of a longer one."""
    whole = made.groupBy("n", "p1", "p2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_logged"))
    proper = made.select(F.explode("prefixes").alias("p")).select("p.*").distinct()
    return whole.join(proper, ["n", "p1", "p2"], "left_anti").select("conv", F.col("n").alias("n_turns"), "n_logged")


def render(turns: DataFrame, conv_col: str = "conv_id", **columns: str) -> DataFrame:
    """conv_col, n_turns, n_logged (equal conversations), chat: the maximal conversations, rendered."""
    made = conversations(turns, conv_col, **columns)
    return made.select("conv", "chat").join(collapse(made), "conv").select(F.col("conv").alias(conv_col), "n_turns", "n_logged", "chat")

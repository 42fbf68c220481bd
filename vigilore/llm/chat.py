"""Collapse of cumulative conversation snapshots, then rendering.

Chat logs often store a conversation again after every turn.  Each turn gets a
rolling hash of the turns up to it: the exclusive or of position-dependent hashes
of (position, role, text), in two independent 64-bit lanes.  A conversation whose
hash at its end is found inside a longer one is a prefix of it and goes, by an
anti-join; of equal conversations the smallest id stays.

The running hash is built in two levels (parts of a conversation, then their totals),
so a conversation with a third of all rows is spread over tasks.  A part is a range of
``turn``; where one range holds very many rows (turns that are null or repeated), its
parts are told by turn, role and the first letters of the text, which keeps their order.

Defined cases: null roles and texts are values of their own; rows that repeat a
turn are turns in order of role and text; a null conversation id is one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

#: Turns numbered in one go, and a quarter of the rows that one part may hold.
TURN_RANGE = 512


def _lane(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def turn_prefixes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, n_turns, role, text, p1, p2, h1, h2): position, prefix hash and whole hash."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("range", F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(-1)) / TURN_RANGE))
    crowded = rows.groupBy(F.col("conv_id").alias("k"), F.col("range").alias("kr")).agg(F.count("*").alias("n")).where(F.col("n") > 4 * TURN_RANGE).select("k", "kr", F.lit(True).alias("crowded"))
    rows = rows.join(crowded, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("range") == F.col("kr")), "left")
    finer = F.when(F.col("crowded"), F.struct("turn", "role", F.substring("text", 1, 2).alias("head")))
    rows = rows.select("conv_id", "turn", "role", "text", F.struct("range", finer.alias("finer")).alias("part"))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("conv_id").alias("k"), F.col("part").alias("kp"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(whole).alias("n_turns"))
    same = lambda a: (F.col("conv_id").eqNullSafe(a["k"])) & (F.col("part").eqNullSafe(a["kp"]))
    rows = rows.withColumn("local", F.row_number().over(inside))
    rows = rows.join(counts, same(counts)).withColumn("pos", F.col("ahead") + F.col("local")).drop("k", "kp", "ahead")
    rows = materialize(rows.withColumn("e1", _lane(1)).withColumn("e2", _lane(2)), "turns")
    totals = rows.groupBy("conv_id", "part").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    zero = F.lit(0).cast("long")
    totals = totals.select(
        F.col("conv_id").alias("k"),
        F.col("part").alias("kp"),
        *[F.coalesce(F.bit_xor(f"x{i}").over(before), zero).alias(f"b{i}") for i in (1, 2)],
        *[F.bit_xor(f"x{i}").over(whole).alias(f"h{i}") for i in (1, 2)],
    )
    running = Window.partitionBy("conv_id", "part").orderBy("pos")
    rows = rows.withColumns({f"r{i}": F.bit_xor(f"e{i}").over(running) for i in (1, 2)})
    return rows.join(totals, same(totals)).select(
        "conv_id", "pos", "n_turns", "role", "text", *[F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"p{i}") for i in (1, 2)], "h1", "h2"
    )


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of a longer one, once each."""
    ends = prefixes.where("pos = n_turns").select("conv_id", "n_turns", "h1", "h2")
    inner = prefixes.where("pos < n_turns").select(F.col("pos").alias("n_turns"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).distinct()
    once = ends.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    return once.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_equal")


def render(turn: Column, role: Column, text: Column) -> Column:
    """One turn of the chat template; the turns of a conversation follow each other."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def collapse_and_render(turns: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, turn_index, n_turns, rendered) of every turn of the maximal conversations.

    A rendered conversation is the concatenation of its rows; it is left in turns so
    that no task has to hold a whole conversation.
    """
    prefixes = materialize(turn_prefixes(turns, **columns), "turn-prefixes")
    kept = maximal_conversations(prefixes).select(F.col("conv_id").alias("kept_id"))
    rows = prefixes.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return rows.select("conv_id", F.col("pos").alias("turn_index"), "n_turns", render(F.col("pos"), F.col("role"), F.col("text")).alias("rendered"))

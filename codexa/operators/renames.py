"""The order in which a plan's moves can be made, without one overwriting another.

A move whose target is another's source waits for that one.  Sources and targets are
unique in a plan, so the moves part into chains and cycles.  How many moves each has
before it comes from pointer doubling, in as many rounds as the logarithm of the longest
chain; moves that never come to an end lie on a cycle.  A chain starts at its free
end.  Of a cycle, the least move goes to a temporary name first and to its target last.
What would end on a file that stays is blocked, and so is all that waits for it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


_STATE = ("next", "steps", "least", "away", "last", "stays")


def _doubled(links: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Rows of chains and rows of cycles, after so many doublings of (plan, old, new, next, stays).

    A chain's rows have the ``steps`` to its ``last`` row, and whether that one ``stays``
    put; a cycle's rows have its ``least`` source and how far ``away`` that is.
    """
    zero = F.lit(0).cast("long")
    state = cut(links.select("plan", "old", "new", "next", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long").alias("steps"), F.col("old").alias("least"), zero.alias("away"), F.col("old").alias("last"), "stays"))
    ended, going = state.filter("next IS NULL"), state.filter("next IS NOT NULL")
    open_ = True
    for _ in range(rounds):
        if going.isEmpty():
            break
        # As long as a chain is not at its end, each round brings some row of it there; then what goes on is on cycles, and asks for such rows alone.
        ahead = (ended.unionByName(going) if open_ else going).select("plan", F.col("old").alias("next"), *[F.col(c).alias(f"n_{c}") for c in _STATE])
        nearer = F.col("n_least") < F.col("least")
        state = cut(going.join(ahead, ["plan", "next"]).select(
            "plan", "old", "new", F.col("n_next").alias("next"), (F.col("steps") + F.col("n_steps")).alias("steps"), F.least("least", "n_least").alias("least"),
            F.when(nearer, F.col("steps") + F.col("n_away")).otherwise(F.col("away")).alias("away"), F.col("n_last").alias("last"), F.col("n_stays").alias("stays"),
        ))
        arrived, going = state.filter("next IS NULL"), state.filter("next IS NOT NULL")
        if open_:
            open_ = not arrived.isEmpty()
            ended = ended.unionByName(arrived)
    return ended, going


def ordered(moves: DataFrame, files: DataFrame, temporary: str = ".tmp_") -> DataFrame:
    """(plan, chain, step, source, target, kind, blocked) of (plan, old, new) moves over (plan, path) files.

    Steps of a chain go by number; chains don't depend on each other.  ``kind`` is move,
    or for the least move of a cycle aside and back.  Moves to where the file is are left out.
    """
    rows = cut(moves.filter("old <> new").select("plan", "old", "new"))
    longest = rows.groupBy("plan").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rounds = math.ceil(math.log2(longest + 1)) + 1
    there = files.select("plan", F.col("path").alias("new"), F.lit(False).alias("moves")).unionByName(rows.select("plan", F.col("old").alias("new"), F.lit(True).alias("moves")))
    there = there.groupBy("plan", "new").agg(F.max("moves").alias("moves"))
    linked = rows.join(there, ["plan", "new"], "left").select("plan", "old", "new", F.when(F.col("moves"), F.col("new")).alias("next"), F.coalesce(~F.col("moves"), F.lit(False)).alias("stays"))
    chains, cycles = _doubled(linked, rounds)
    # The least row of a cycle comes last, and the one that is farthest from it follows it.
    whole = F.max("away").over(Window.partitionBy("plan", "least"))
    steps = F.when(F.col("away") == 0, whole).otherwise(F.col("away") - 1)
    rows = chains.select("plan", "old", "new", F.lit(None).cast("string").alias("chain"), "last", "steps", F.col("stays").alias("blocked")).unionByName(
        cycles.select("plan", "old", "new", F.col("least").alias("chain"), "last", steps.alias("steps"), F.lit(False).alias("blocked")))
    first = F.col("chain").isNotNull() & (F.col("old") == F.col("chain"))
    aside = F.concat("old", F.lit(temporary), F.left(F.sha2(F.concat_ws("\n", "plan", "old"), 256), F.lit(8)))
    one = F.struct(F.when(F.col("chain").isNull(), F.col("steps")).otherwise(F.col("steps") + 1).alias("step"), F.col("old").alias("source"), F.col("new").alias("target"), F.lit("move").alias("kind"))
    two = F.array(
        F.struct(F.lit(0).cast("long").alias("step"), F.col("old").alias("source"), aside.alias("target"), F.lit("aside").alias("kind")),
        F.struct((F.col("steps") + 1).alias("step"), aside.alias("source"), F.col("new").alias("target"), F.lit("back").alias("kind")),
    )
    named = F.coalesce("chain", "last").alias("chain")
    return rows.select("plan", named, F.explode(F.when(first, two).otherwise(F.array(one))).alias("m"), "blocked").select("plan", "chain", "m.*", "blocked")

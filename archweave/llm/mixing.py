"""Mixing sources to target weights by proportionate-fair scheduling.

A source of weight w (ticks of a period) is owed its j-th block between the release floor(j / w) and the deadline
ceil((j + 1) / w). One slot holds one block; earliest deadline first among the released meets every deadline, so at
every slot each source has had its share to within less than one block. Weights are whole ticks of a period, so the
schedule repeats, and one period, whose length is a parameter, is all that the driver works out. The slot of any
block follows by arithmetic, and no task sees more of a source than its own rows.

Documents of a source are numbered in the order of a hash of their ids and cut into blocks of ``block_docs``, of which
only the last may be smaller, so what holds for slots holds for documents. Numbers come from one range sort: a task
numbers its own rows, and the sizes of the runs before them, one per task and source, are added. Slots of a source
that has run out stay empty, and the order of the rest holds; no document is dropped or repeated.

Defined results: a null source is a source of its own, named ``null``; null and repeated ids keep all their rows, in
any order among themselves; a source without a given weight gets the weight of its size; an empty table gives an empty
result; texts are carried whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archweave.llm.common import Stage

BLOCK_DOCS, PERIOD, TEMPERATURE = 32, 2_000, 0.7
#: Sources that one period can serve; more is an error, never a cut.
MOST_SOURCES = 20_000
#: Below these bits Spark's increasing ids count the rows of a task, above them the tasks.
TASK_BITS = 33
ADDED = ("mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline")


def ticks(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole ticks that add up to the period, largest remainders first, one for every source at least."""
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights have to be positive and finite")
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (out[s] - exact[s], s))
    while (left := period - sum(out.values())) > 0:
        for s in order[:left]:
            out[s] += 1
    while (over := sum(out.values()) - period) > 0:
        for s in [s for s in sorted(out, key=lambda s: (exact[s] - out[s], s)) if out[s] > 1][:over]:
            out[s] -= 1
    return out


def schedule(shares: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, j, slot, release, deadline) of one period, by earliest deadline first; the later weightier on ties."""
    period = sum(shares.values())
    release = lambda s, j: j * period // shares[s]
    deadline = lambda s, j: -(-(j + 1) * period // shares[s])
    waiting = [(0, s, 0) for s in shares]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(s, j), -shares[s], s, j))
        due, _, s, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline is missed")
        out.append((s, j, slot, release(s, j), due))
        if j + 1 < shares[s]:
            heapq.heappush(waiting, (release(s, j + 1), s, j + 1))
    return out


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, *, block_docs: int = BLOCK_DOCS, period: int = PERIOD, id_col: str = "doc_id", source_col: str = "source", in_order: bool = True) -> DataFrame:
    """``docs`` with mix_source, mix_block, mix_slot, mix_release, mix_deadline, in slot order across and within files.

    Without ``in_order`` the rows only learn their slots and are not sorted by them.

    Columns of ``docs`` that have these names are replaced; all others ride along as one value, so no name can clash.
    Broadcast are one row per source (at most MOST_SOURCES, checked), one per slot of a period, and one per run of a
    source in a task of the sort (their ranges follow one another: no more than there are tasks and sources together).
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("null")).alias("mix_source"), F.col(id_col).cast("string").alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    sizes = rows.groupBy("mix_source").agg(F.count("*").alias("n"))
    counted = {r["mix_source"]: r["n"] for r in sizes.limit(MOST_SOURCES + 1).collect()}
    if len(counted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    kept = [c for c in docs.columns if c not in ADDED]
    if not counted:
        return docs.select(*kept, F.lit(None).cast("string").alias("mix_source"), *(F.lit(None).cast("long").alias(c) for c in ADDED[1:]))
    wanted = {s: float((weights or {}).get(s, n**TEMPERATURE)) for s, n in sorted(counted.items())}
    shares = ticks(wanted, period)
    turn = sum(shares.values())
    plan = spark.createDataFrame([(s, shares[s]) for s in counted], "mix_source string, share long")
    slots = spark.createDataFrame(schedule(shares), "mix_source string, j long, at long, release long, due long")
    # a third of all rows may share an id, or have none: their order of arrival lets a range end among them
    keys = ["mix_source", "h", "key", "seq"]
    numbered = rows.withColumns({"h": F.md5(F.coalesce("key", F.lit("null"))), "seq": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = Stage(spark, "mix").write(numbered.select("mix_source", "key", "row", F.monotonically_increasing_id().alias("n_th")))
    task = F.shiftright("n_th", TASK_BITS).alias("task")
    runs = numbered.groupBy("mix_source", task).agg(F.min("n_th").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("mix_source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("mix_source", "task", (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"))
    ranked = numbered.withColumn("task", task).join(F.broadcast(runs), ["mix_source", "task"])
    dealt = ranked.join(F.broadcast(plan), "mix_source").withColumn("mix_block", F.floor((F.col("n_th") + F.col("shift")) / block_docs)).withColumn("j", F.col("mix_block") % F.col("share"))
    base = F.floor(F.col("mix_block") / F.col("share")) * turn
    placed = dealt.join(F.broadcast(slots), ["mix_source", "j"]).withColumns({f"mix_{c}": base + F.col(k) for c, k in (("slot", "at"), ("release", "release"), ("deadline", "due"))})
    ordered = placed.repartitionByRange("mix_slot", "n_th").sortWithinPartitions("mix_slot", "key") if in_order else placed
    return ordered.select(*(F.col(f"row.`{c}`") for c in kept), *ADDED)

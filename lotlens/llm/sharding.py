"""Balanced label propagation: equal texts move to one shard under exact row quotas.

Documents with equal text are linked. Links are cliques, so the state is one row per (class, shard)
with a count instead of one row per document. Each round joins every class with its preferred shard
(where most of it lies already; several for a class larger than a shard), classes ask to move there,
and of each flow between two shards as much is accepted as keeps both within ``SLACK`` times their quotas,
splitting a class where it must. At the end a shard over its quota keeps its largest parts of classes. Documents without links and what
was not accepted fill the shards up to their quotas at the end, so that row counts differ by at most
one. Ranks within a shard or class are prefix sums over hash buckets, whose totals are themselves added up
in two steps: no class, shard or other group is ever sorted in one task, and nothing is broadcast.

Edge cases: null text counts as empty; null and repeated ids are placed like others, ranked by their
hash; a class of any size may span shards; texts count by their hash, whatever their length; fewer
documents than shards leave some shards empty; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import whole, written

SHARDS = 16
ROUNDS = 3
#: Shards may hold so many times their quota while labels spread; settling restores the quota exactly.
SLACK = 2
BUCKETS = 64
ROWS_PER_BUCKET = 20_000
RUN = 1024


def _ahead(totals: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, ahead): the total of all smaller ``order`` of the same key, added up by runs of ``RUN`` first."""
    runs = totals.withColumn("run", F.floor(F.col(order) / F.lit(RUN)))
    whole_runs = runs.groupBy(key, "run").agg(F.sum("total").alias("of_run"))
    before = whole_runs.select(key, "run", (F.sum("of_run").over(W.partitionBy(key).orderBy("run")) - F.col("of_run")).alias("before"))
    inside = F.sum("total").over(W.partitionBy(key, "run").orderBy(order)) - F.col("total")
    return runs.withColumn("inside", inside).join(before, [key, "run"]).select(key, order, (F.col("before") + F.col("inside")).alias("ahead"))


def _room(pieces: DataFrame, buckets: int, salt: int, large_first: bool = False) -> DataFrame:
    """``pieces`` (to, cls, cnt, ...) with ``before``: how many go to the same shard ahead of each.

    The order is by hash bucket, then class, or by power of two of the count before that.
    """
    rank = (F.lit(64) - F.floor(F.log2("cnt"))) * buckets if large_first else F.lit(0)
    placed = pieces.withColumn("bkt", rank + F.pmod(F.xxhash64(F.lit(salt), "cls"), F.lit(buckets)))
    totals = placed.groupBy("to", "bkt").agg(F.sum("cnt").alias("total"))
    ahead = _ahead(totals, "to", "bkt")
    within = F.sum("cnt").over(W.partitionBy("to", "bkt").orderBy("cls", "shard").rowsBetween(W.unboundedPreceding, -1))
    return placed.withColumn("within", F.coalesce(within, F.lit(0))).join(ahead, ["to", "bkt"]).withColumn("before", F.col("ahead") + F.col("within")).drop("bkt", "within", "ahead")


def _lookup(values: dict[int, int], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(values.get(s, 0))).cast("bigint") for s in range(max(values) + 1)]), (key + 1).cast("int"))


def _loads(state: DataFrame, shards: int) -> dict[int, int]:
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("cnt").alias("n")).collect()}  # a row for each shard
    return {s: found.get(s, 0) for s in range(shards)}


def accepted(asked: dict[tuple[int, int], int], loads: dict[int, int], quota: dict[int, int]) -> dict[tuple[int, int], int]:
    """How much of each asked flow (from, to) keeps every shard within its quota; at most shards^2 numbers."""
    flow = dict(asked)
    for _ in range(len(quota) ** 2):
        over = {}
        for s in quota:
            coming = sum(n for (_, t), n in flow.items() if t == s)
            going = sum(n for (f, _), n in flow.items() if f == s)
            if coming and loads[s] + coming - going > quota[s]:
                over[s] = max(0, coming - (loads[s] + coming - going - quota[s])) / coming
        if not over:
            return flow
        flow = {(f, t): int(n * over.get(t, 1)) for (f, t), n in flow.items()}
    return dict.fromkeys(asked, 0)


def propagate(state: DataFrame, quota: dict[int, int], rounds: int = ROUNDS, buckets: int = BUCKETS) -> DataFrame:
    """(cls, shard, cnt) after ``rounds`` of moves towards where most of each class lies.

    A class larger than a shard aims at as many shards as it needs.
    """
    shards = len(quota)
    for turn in range(rounds):
        loads = _loads(state, shards)
        spread = state.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("c"), F.xxhash64("cls", "shard").alias("h"), "shard"))).alias("places"), F.sum("cnt").alias("n"))
        need = F.ceil(F.col("n") / F.lit(max(1, min(quota.values())))).cast("int")
        wish = spread.filter(F.size("places") > need).select("cls", F.transform(F.slice("places", F.lit(1), need), lambda x: x["shard"]).alias("aims"))
        asking = state.join(wish, "cls", "left")
        moving = F.col("aims").isNotNull() & ~F.array_contains("aims", F.col("shard"))
        to = F.get("aims", F.pmod("shard", F.size("aims")))
        moves = written(asking.filter(moving).select("cls", "shard", "cnt", to.alias("aim"), (F.col("shard") * shards + to).alias("to")), "moves")
        asked = {(r["to"] // shards, r["to"] % shards): r["n"] for r in moves.groupBy("to").agg(F.sum("cnt").alias("n")).collect()}  # shards^2 rows at most
        flow = accepted(asked, loads, {s: SLACK * q for s, q in quota.items()})
        if not any(flow.values()):
            break
        limit = _lookup({f * shards + t: n for (f, t), n in flow.items()} | {shards**2 - 1: flow.get((shards - 1, shards - 1), 0)}, F.col("to"))
        ranked = _room(moves, buckets, turn).withColumn("taken", F.greatest(F.lit(0), F.least(F.col("cnt"), limit - F.col("before"))))
        moved = ranked.select("cls", F.col("aim").alias("shard"), F.col("taken").alias("cnt"))
        left = ranked.select("cls", "shard", (F.col("cnt") - F.col("taken")).alias("cnt"))
        stay = asking.filter(~moving).select("cls", "shard", "cnt")
        merged = stay.unionByName(moved).unionByName(left).filter("cnt > 0")
        state = written(merged.groupBy("cls", "shard").agg(F.sum("cnt").alias("cnt")), "labels")
    return state


def settle(linked: DataFrame, single: DataFrame, quota: dict[int, int], buckets: int) -> DataFrame:
    """(cls, shard, cnt) for all classes with exactly ``quota`` rows in each shard."""
    ranked = _room(linked.withColumn("to", F.col("shard")), buckets, -1, large_first=True)
    keep = F.greatest(F.lit(0), F.least(F.col("cnt"), _lookup(quota, F.col("shard")) - F.col("before")))
    ranked = written(ranked.select("cls", "shard", "cnt", keep.alias("keep")), "settled")
    kept = ranked.select("cls", "shard", F.col("keep").alias("cnt")).filter("cnt > 0")
    used = _loads(kept, len(quota))
    free = ranked.filter("cnt > keep").groupBy("cls").agg(F.sum(F.col("cnt") - F.col("keep")).alias("cnt")).unionByName(single.select("cls", "cnt"))
    pool = _room(free.withColumn("to", F.lit(0)).withColumn("shard", F.lit(0)), buckets, -2).drop("to", "shard")
    first, slices = 0, []
    for s in sorted(quota):
        room = quota[s] - used[s]
        slices.append(F.struct(F.lit(s).alias("shard"), F.lit(first).cast("bigint").alias("lo"), F.lit(first + room).cast("bigint").alias("hi")))
        first += room
    met = F.filter(F.array(*slices), lambda s: (s["lo"] < F.col("before") + F.col("cnt")) & (s["hi"] > F.col("before")))
    parts = pool.select("cls", "cnt", "before", F.explode(met).alias("s")).select(
        "cls", F.col("s.shard").alias("shard"), (F.least(F.col("before") + F.col("cnt"), F.col("s.hi")) - F.greatest("before", F.col("s.lo"))).alias("cnt")
    )
    return kept.unionByName(parts.filter("cnt > 0"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (always null here)."""
    text = whole(text_col)
    raw = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("cls"), F.xxhash64(F.col(id_col)).alias("tie"),
    )
    rows = written(raw, "shard-rows")
    n = rows.count()
    salts = buckets = max(BUCKETS, -(-n // ROWS_PER_BUCKET))
    quota = {s: n // shards + (s < n % shards) for s in range(shards)}
    rows = rows.withColumn("salt", F.pmod("tie", F.lit(salts)))
    salted = written(rows.groupBy("cls", "salt").agg(F.count("*").alias("cnt")), "shard-salted")
    sizes = written(salted.groupBy("cls").agg(F.sum("cnt").alias("n")).filter("n > 1").select("cls", "n"), "shard-classes")
    linked = salted.join(sizes, "cls").groupBy("cls", F.pmod("salt", F.lit(shards)).cast("int").alias("shard")).agg(F.sum("cnt").alias("cnt"))
    single = salted.join(sizes, "cls", "left_anti")
    state = propagate(written(linked, "labels"), quota, rounds, buckets)
    final = written(settle(state, single, quota, buckets), "shard-final")
    upto = F.sum("cnt").over(W.partitionBy("cls").orderBy("shard"))
    ends = final.select("cls", "shard", upto.alias("upto")).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("ends"))
    offset = F.sum("cnt").over(W.partitionBy("cls").orderBy("salt")) - F.col("cnt")
    places = written(salted.select("cls", "salt", offset.alias("offset")).join(ends, "cls"), "shard-places")
    rank = F.row_number().over(W.partitionBy("cls", "salt").orderBy("tie", "doc_id")) - 1
    ranked = rows.withColumn("rank", rank).join(places, ["cls", "salt"])
    at = F.col("offset") + F.col("rank")
    shard = F.element_at(F.filter("ends", lambda e: e["upto"] > at), 1)["shard"]
    placed = written(ranked.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), "tie", F.pmod("tie", F.lit(salts)).alias("part")), "shard-placed")
    totals = placed.groupBy("shard", "part").agg(F.count("*").alias("total"))
    ahead = _ahead(totals, "shard", "part")
    within = F.row_number().over(W.partitionBy("shard", "part").orderBy("tie", "doc_id", "text_crc32")) - 1
    slotted = placed.withColumn("within", within).join(ahead, ["shard", "part"])
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("ahead") + F.col("within")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

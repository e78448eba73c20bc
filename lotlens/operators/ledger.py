"""Ledgers of collection runs, their roll-ups and reconciliation, and plans for closing row gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import mapped

LEDGER_STATUSES = ("pass", "no_inventory")
#: Shares of a planned snapshot by source; the first one gets what rounding leaves.
ALLOCATION = {"true_value": 0.50, "mahindra_first_choice": 0.30, "spinny": 0.20}
SCENARIOS = {"original_baseline_scope": 909, "small_scale": 2_500, "recommended": 5_000, "stretch": 10_000}


def ledger(runs: DataFrame) -> DataFrame:
    """The first row of each (source, run_id) among those that passed or had no inventory.

    ``runs``: precedence (0 for source manifests, 1 for batch jobs), position, source, run_id, status, ...
    """
    w = W.partitionBy("source", "run_id").orderBy("precedence", "position")
    return runs.filter(F.col("status").isin(*LEDGER_STATUSES)).withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def job_rows(jobs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Passing jobs with their source manifest's status, 'missing_source_manifest' where there is none."""
    passing = jobs.filter(F.col("job_status").isin(*LEDGER_STATUSES) & (F.col("exit_code") == 0))
    found = passing.join(manifests, ["source", "run_id"], "left")
    status = F.when(F.col("manifest_status").isNull(), "missing_source_manifest").when(F.col("job_status") == "no_inventory", "no_inventory").otherwise(F.col("manifest_status"))
    return found.withColumn("status", status)


def preferred_manifest(found: DataFrame, preferred_date: Column) -> DataFrame:
    """Of the manifests found for a run, the one of the preferred date, else the earliest."""
    w = W.partitionBy("source", "run_id").orderBy(F.desc(F.col("capture_date").eqNullSafe(preferred_date)), "capture_date")
    return found.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def _sums() -> list[Column]:
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n)
    has = lambda s: F.count_if(F.col("status") == s)
    return [
        F.count("*").alias("source_runs"), has("pass").alias("listing_source_runs"), total("pricing_ready", "pricing_ready"), total("quarantined", "quarantined"),
        total("source_total_items", "source_total_signal"), has("no_inventory").alias("no_inventory_source_runs"),
    ]


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(*_sums())


def totals_by_source(rows: DataFrame) -> DataFrame:
    """As :func:`totals` for each source that has a name."""
    return rows.filter(F.coalesce(F.col("source"), F.lit("")) != "").groupBy("source").agg(*_sums())


def rollup(rows: DataFrame) -> DataFrame:
    """Each source and, under a null source, all of them."""
    return rows.rollup("source").agg(*_sums())


def target_delta(current: Column, target: Column) -> list[Column]:
    """How a total stands to its target: under, over or at."""
    state = F.when(current < target, "rows_under_target").when(current > target, "rows_over_target").otherwise("rows_at_target")
    return [state.alias("target_state"), F.abs(current - target).alias("target_rows")]


def checks(pairs: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Named reconciliation tests over a one-row table of figures: (check, status)."""
    return pairs.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.when(F.coalesce(t, F.lit(False)), "pass").otherwise("fail").alias("status")) for n, t in tests.items()])).alias("c")).select("c.*")


def require(checked: DataFrame) -> DataFrame:
    """``checked``, or ``ValueError`` naming what failed (a handful of rows reach the driver)."""
    wrong = [r["check_name"] for r in checked.filter("status <> 'pass'").collect()]
    if wrong:
        raise ValueError(f"checks failed: {', '.join(sorted(wrong))}")
    return checked


def scope(rows: DataFrame) -> DataFrame:
    named = lambda c: F.sort_array(F.collect_set(F.nullif(F.col(c), F.lit("")))).alias(f"{c}_set")
    return rows.agg(named("source"), named("city"))


def batch_status(jobs) -> DataFrame:
    """planned without a run, empty without jobs, pass if all exit with 0, else fail; for a table or a grouping of one."""
    one = jobs.agg(F.count("*").alias("jobs"), F.count("exit_code").alias("ran"), F.coalesce(F.bool_and(F.col("exit_code") == 0), F.lit(False)).alias("all_ok"))
    return one.withColumn("status", F.when(F.col("jobs") == 0, "empty").when(F.col("ran") == 0, "planned").when((F.col("ran") == F.col("jobs")) & F.col("all_ok"), "pass").otherwise("fail")).drop("all_ok")


def resume(jobs: DataFrame, passed: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs marked skipped where an earlier run passed them, else planned."""
    done = passed.select(*keys, F.lit(True).alias("__done")).distinct()
    return jobs.join(done, keys, "left").withColumn("state", F.when(F.col("__done"), "skipped").otherwise("planned")).drop("__done")


def select_jobs(jobs: DataFrame, ids: list[str] | None = None, statuses: tuple[str, ...] = ("validated",)) -> DataFrame:
    """Jobs by id, which must all exist, else by status."""
    if ids is None:
        return jobs.filter(F.col("status").isin(*statuses))
    known = {r["batch_id"] for r in jobs.filter(F.col("batch_id").isin(*ids)).select("batch_id").distinct().collect()}
    if unknown := sorted(set(ids) - known):
        raise ValueError(f"unknown batch ids: {', '.join(unknown)}")
    return jobs.filter(F.col("batch_id").isin(*ids))


def scale_projection(figures: DataFrame, target: int, scenarios: dict[str, int] = SCENARIOS) -> DataFrame:
    """How many snapshots of each size close the gap (``figures``: one row with ``current``)."""
    left = F.greatest(F.lit(target) - F.col("current"), F.lit(0))
    rows = F.explode(F.array(F.struct(F.lit("current_checkpoint_size").alias("scenario"), F.col("current").cast("bigint").alias("rows")), *[F.struct(F.lit(n).alias("scenario"), F.lit(r).cast("bigint").alias("rows")) for n, r in scenarios.items()]))
    out = figures.select("current", left.alias("remaining"), rows.alias("s")).select("s.scenario", F.col("s.rows").alias("rows_per_snapshot"), "current", "remaining")
    need = F.when(F.col("rows_per_snapshot") > 0, F.ceil(F.col("remaining") / F.nullif(F.col("rows_per_snapshot"), F.lit(0)))).otherwise(0).cast("bigint")
    out = out.withColumn("future_snapshots", need)
    return out.withColumns({"total_snapshots": F.col("future_snapshots") + (F.col("current") > 0).cast("int"), "projected_observations": F.col("current") + F.col("future_snapshots") * F.col("rows_per_snapshot")})


def allocate(rows: int, shares: dict[str, float] = ALLOCATION) -> dict[str, int]:
    """Whole rows by share; the first source gets the remainder."""
    out = {s: int(rows * share) for s, share in shares.items()}
    out[next(iter(shares))] += rows - sum(out.values())
    return out


def gap_strategy(by_source: DataFrame, targets: dict[str, int], target_total: int) -> DataFrame:
    """For each planned source its gap, surplus, fill and status, by ordered rules."""
    spark = by_source.sparkSession
    plan = spark.createDataFrame([(s, n) for s, n in targets.items()], "source string, target_rows bigint")
    rows = plan.join(by_source.select("source", F.col("pricing_ready").alias("current_rows")), "source", "left").fillna(0, ["current_rows"])
    now, aim = F.col("current_rows"), F.col("target_rows")
    gap = F.greatest(aim - now, F.lit(0))
    fill = F.when(aim > 0, F.bround(now / F.nullif(aim, F.lit(0)) * 100, 2)).otherwise(0.0)
    open_state = mapped({"mahindra_first_choice": "capacity_constrained", "spinny": "incremental_expansion_needed"}, F.col("source"))
    status = F.when((aim > 0) & (now > aim), "over_allocation").when(gap == 0, "allocation_met").when((F.col("source") == "true_value") & (fill >= 95), "near_allocation").otherwise(F.coalesce(open_state, F.lit("under_allocation")))
    cap = F.when(F.col("source") == "spinny", F.least(gap, F.lit(200))).when(F.col("source") == "mahindra_first_choice", F.least(gap, F.lit(300))).otherwise(gap)
    share = F.bround(now / F.lit(float(target_total)) * 100, 2) if target_total else F.lit(0.0)
    return rows.select("source", "current_rows", "target_rows", gap.alias("allocation_gap"), F.greatest(now - aim, F.lit(0)).alias("over_allocation"), fill.alias("fill_pct"), share.alias("current_share_pct"), status.alias("status"), cap.alias("next_rows"))

"""Further registered queries: relisted vehicles, complete rows through the quality gate, external files, captures, batches and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import baseline, captures, external, ledger, lifecycle, metrics, profiling, quality
from ..sources import payloads
from ..sources.tables import listings, table
from . import combined, manifests
from .catalogue import _FIELDS, _REASONS, FINGERPRINT, IDENTIFIED, LADDER, SEED, halves, query

# --- relisted vehicles: the same cars offered again under another URL -----------------------------------

RELISTED = FINGERPRINT.replace("WITH ", """WITH relisted AS (
  SELECT * FROM listings
  UNION ALL SELECT * REPLACE (record_index + 1000000000 AS record_index, CASE WHEN listing_url IS NOT NULL THEN 'HTTPS://Cars.Example//again/' || record_key || '/?q=1' END AS listing_url) FROM listings WHERE record_index % 10 IN (1, 3)
), """, 1).replace("FROM listings\n)", "FROM relisted\n)")  # fmt: skip


def relisted(spark, sf_dir):
    rows = listings(spark, sf_dir)
    again = F.when(F.col("listing_url").isNotNull(), F.concat(F.lit("HTTPS://Cars.Example//again/"), "record_key", F.lit("/?q=1")))
    second = rows.filter((F.col("record_index") % 10).isin(1, 3)).withColumns({"record_index": F.col("record_index") + 1_000_000_000, "listing_url": again})
    return lifecycle.with_fingerprint(lifecycle.with_identity(rows.unionByName(second)))


@query(RELISTED + """ SELECT vehicle_fingerprint, count(*) AS observation_count, count(DISTINCT listing_key) AS listing_key_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  string_agg(DISTINCT city, ',' ORDER BY city) AS cities, string_agg(DISTINCT listing_key, ',' ORDER BY listing_key) AS listing_keys
FROM printed WHERE vehicle_fingerprint <> '' GROUP BY vehicle_fingerprint HAVING count(DISTINCT listing_key) > 1""")  # fmt: skip
def relisted_duplicate_groups(spark, sf_dir):
    groups = lifecycle.duplicate_vehicles(relisted(spark, sf_dir))
    return groups.select("vehicle_fingerprint", "observation_count", "listing_key_count", *[F.array_join(c, ",").alias(c) for c in ("sources", "cities", "listing_keys")])


@query(RELISTED + """, k AS (SELECT source, listing_key, count(*) AS n FROM printed GROUP BY source, listing_key),
g AS (SELECT vehicle_fingerprint FROM printed WHERE vehicle_fingerprint <> '' GROUP BY 1 HAVING count(DISTINCT listing_key) > 1),
d AS (SELECT source, count(DISTINCT vehicle_fingerprint) AS n FROM printed WHERE vehicle_fingerprint IN (SELECT vehicle_fingerprint FROM g) GROUP BY source)
SELECT k.source, CAST(sum(k.n) AS BIGINT) AS records, count(*) AS unique_listing_keys, CAST(sum(CASE WHEN k.n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS reobserved_listing_groups, coalesce(max(d.n), 0) AS possible_vehicle_duplicate_groups
FROM k LEFT JOIN d ON k.source = d.source GROUP BY k.source""")
def relisted_totals_by_source(spark, sf_dir):
    return lifecycle.totals_by_source(relisted(spark, sf_dir))


@query(RELISTED + """, k AS (SELECT listing_key, count(*) AS n FROM printed GROUP BY 1), g AS (SELECT vehicle_fingerprint FROM printed WHERE vehicle_fingerprint <> '' GROUP BY 1 HAVING count(DISTINCT listing_key) > 1)
SELECT CAST(sum(n) AS BIGINT) AS records_total, count(*) AS unique_listing_keys, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS reobserved_listing_groups, (SELECT count(*) FROM g) AS possible_vehicle_duplicate_groups FROM k""")
def relisted_totals(spark, sf_dir):
    return lifecycle.totals(relisted(spark, sf_dir))


@query(IDENTIFIED + """, r AS (SELECT *, row_number() OVER (PARTITION BY listing_key ORDER BY captured_at DESC, run_id DESC, record_index DESC) AS nth, count(*) OVER (PARTITION BY listing_key) AS n FROM identified)
SELECT listing_key, n AS observation_count, record_index, source, city, brand, model, model_year, km_driven, listed_price_inr FROM r WHERE nth = 1""")
def unique_latest_export(spark, sf_dir):
    """One row per listing from the full history: the latest sighting's fields and how many there were."""
    fields = ("record_index", "source", "city", "brand", "model", "model_year", "km_driven", "listed_price_inr")
    rows = lifecycle.with_identity(listings(spark, sf_dir))
    rows = rows.withColumns({"capture_date": F.col("captured_at"), "run_id": F.col("run_id")})
    return lifecycle.entities(rows, fields).select("listing_key", "observation_count", *fields)


# --- rows with every required field through the quality gate --------------------------------------------

_SAID = [r for r in _REASONS if r[1] != "TRUE"]
_BLOCKING = "(listing_url IS NULL AND source_listing_id IS NULL) OR model_year NOT BETWEEN 1990 AND 1998 OR currency <> 'INR'"
_READY = "WITH j AS (SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _SAID) + f") AS reasons, NOT ({_BLOCKING}) AS silver FROM listings)"


def complete(spark, sf_dir):
    constant = {"raw_record_hash": F.col("record_key"), "ingestion_run_id": F.col("run_id"), "parser_version": F.lit("p1"), "schema_version": F.lit("s1")}
    return quality.evaluate(listings(spark, sf_dir).withColumns(constant), 1997)


@query(_READY + " SELECT record_index, reasons, silver AS silver_valid, silver AND reasons = '' AS pricing_ready FROM j")
def complete_quality_flags(spark, sf_dir):
    return complete(spark, sf_dir).select("record_index", F.array_join("reasons", ",").alias("reasons"), "silver_valid", "pricing_ready")


_VERDICT = "count(*) AS total, count(*) FILTER (silver) AS silver, count(*) FILTER (silver AND reasons = '') AS pricing_ready, count(*) FILTER (reasons <> '') AS quarantined"


@query(_READY + f" SELECT {_VERDICT}, 'WARN' AS status, FALSE AS run_ready FROM j")
def complete_run_summary(spark, sf_dir):
    return quality.run_status(quality.run_summary(complete(spark, sf_dir))).select("total", "silver", "pricing_ready", "quarantined", "status", "run_ready")


@query(_READY + f" SELECT {_VERDICT}, CAST(1.0 AS DOUBLE) AS required_avg, 'PASS' AS status, TRUE AS run_ready FROM j WHERE silver AND reasons = ''")
def priced_run_summary(spark, sf_dir):
    """The verdict on a run of which every row may be priced."""
    priced = complete(spark, sf_dir).filter("pricing_ready")
    return quality.run_status(quality.run_summary(priced)).select("total", "silver", "pricing_ready", "quarantined", "required_avg", "status", "run_ready")


@query(_READY + " SELECT r.name, count(*) AS n FROM j, unnest(string_split(reasons, ',')) r(name) WHERE reasons <> '' GROUP BY 1")
def complete_reason_counts(spark, sf_dir):
    return quality.histogram(complete(spark, sf_dir), "reasons")


# --- profiles of runs -----------------------------------------------------------------------------------


@query("""SELECT key, count(*) AS present FROM (SELECT unnest([{'k': 'variant', 'v': variant}, {'k': 'registration', 'v': registration_code}, {'k': 'note', 'v': CASE WHEN record_index % 2 = 0 THEN ' ' ELSE 'seen' END}, {'k': 'never', 'v': NULL}]) AS x FROM listings) t, LATERAL (SELECT x.k AS key, x.v AS v) WHERE v IS NOT NULL AND trim(v) <> '' GROUP BY key""")
def extra_field_counts(spark, sf_dir):
    given = {"variant": F.col("variant"), "registration": F.col("registration_code"), "note": F.when(F.col("record_index") % 2 == 0, " ").otherwise("seen"), "never": F.lit(None).cast("string")}
    rows = listings(spark, sf_dir).select(F.create_map(*[x for k, v in given.items() for x in (F.lit(k), v)]).alias("extra_fields"))
    return quality.extra_field_profile(rows)


_ROUGH = "(SELECT record_index, source, variant, ownership, registration_code, listing_url, source_listing_id, fuel_type, city FROM listings)"


@query("WITH p AS (" + " UNION ALL ".join(f"SELECT 'listing' AS grp, '{f}' AS field, count(*) FILTER ({f} IS NOT NULL AND lower(trim(CAST({f} AS VARCHAR))) NOT IN ('', 'unknown')) AS present, count(*) AS total FROM {_ROUGH}" for f in _FIELDS) + "), r AS (SELECT *, round_even(present / CAST(total AS DOUBLE), 4) AS ratio FROM p) SELECT * FROM r WHERE ratio < 1.0 ORDER BY ratio, grp, field LIMIT 10")
def completeness_gap_report(spark, sf_dir):
    return quality.completeness_gaps(quality.field_profile(listings(spark, sf_dir), {"listing": _FIELDS}))


@query("""SELECT c_custkey, CASE WHEN n >= 20 OR (t > 0 AND t < 20 AND n >= t) THEN TRUE ELSE FALSE END AS covered, n >= coalesce(m, 0) AS enough_for_capture, n >= coalesce(m, 30) AS enough_for_smoke
FROM (SELECT c_custkey, c_custkey % 40 AS n, c_custkey % 23 AS t, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 17 END AS m FROM customer)""", on_listings=False)
def coverage_results(spark, sf_dir):
    """Whether a run has enough records, and the two rules for a missing minimum."""
    k = F.col("c_custkey")
    n, least = k % 40, F.when(k % 3 != 0, k % 17)
    return table(spark, sf_dir, "customer").select("c_custkey", quality.coverage(n, F.lit(20), k % 23).alias("covered"), captures.enough(n, least).alias("enough_for_capture"), captures.enough(n, least, 30).alias("enough_for_smoke"))


@query("""WITH p AS (SELECT source, count(*) AS records, count(DISTINCT city) AS cities, CAST(sum(CASE WHEN is_available THEN 1 ELSE 0 END) AS BIGINT) AS available FROM listings GROUP BY source),
l AS (SELECT source, 'records' AS metric, records AS v FROM p UNION ALL SELECT source, 'cities', cities FROM p UNION ALL SELECT source, 'available', available FROM p)
SELECT metric, max(CASE WHEN source = 'AFRICA' THEN v END) AS "AFRICA", max(CASE WHEN source = 'ASIA' THEN v END) AS "ASIA", max(CASE WHEN source = 'EUROPE' THEN v END) AS "EUROPE" FROM l GROUP BY metric""")
def source_metrics_side_by_side(spark, sf_dir):
    per = listings(spark, sf_dir).groupBy("source").agg(F.count("*").alias("records"), F.count_distinct("city").alias("cities"), F.count_if("is_available").alias("available"))
    return profiling.side_by_side(per, "source", ["records", "cities", "available"], ["AFRICA", "ASIA", "EUROPE"])


@query("SELECT field, string_agg(source, ',' ORDER BY source) AS sources, min(position) AS first_seen FROM (SELECT c_mktsegment AS source, 'f' || (c_custkey % 9) AS field, c_custkey AS position FROM customer WHERE c_custkey % 9 <> length(c_mktsegment) - 4 GROUP BY ALL) GROUP BY field".replace("string_agg(source,", "string_agg(DISTINCT source,"), on_listings=False)
def field_name_union(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 9 != F.length("c_mktsegment") - 4)
    fields = rows.select(F.col("c_mktsegment").alias("source"), F.concat(F.lit("f"), (F.col("c_custkey") % 9).cast("string")).alias("field"), F.col("c_custkey").alias("position"))
    return quality.field_union(fields).select("field", F.array_join("sources", ",").alias("sources"), "first_seen")


@query("""SELECT p_partkey, path, value FROM (SELECT p_partkey, p_brand, p_size FROM part) p, LATERAL (SELECT unnest([{'path': 'brand', 'value': p_brand}, {'path': 'size.number', 'value': CAST(p_size AS VARCHAR)}, {'path': 'size.more.even', 'value': CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END}, {'path': 'list', 'value': '[1,"b"]'}, {'path': 'none', 'value': NULL}], recursive := true)) u""", on_listings=False)
def flattened_extra_fields(spark, sf_dir):
    even = F.when(F.col("p_size") % 2 == 0, "true").otherwise("false")
    text = F.concat(F.lit('{"brand":"'), "p_brand", F.lit('","size":{"number":'), F.col("p_size").cast("string"), F.lit(',"more":{"even":'), even, F.lit('}},"list":[1,"b"],"none":null}'))
    return profiling.flattened(table(spark, sf_dir, "part").select("p_partkey", text.alias("extra")), "p_partkey", "extra")


# --- captures, batches and jobs -------------------------------------------------------------------------


@query("""WITH c AS (SELECT 'k' || (event_id % 997) AS key, event_id // 50 AS page, event_id % 50 AS pos, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page, pos) AS nth FROM c)
SELECT key, page, pos, value FROM r WHERE nth = 1""", on_listings=False)
def scroll_page_dedupe(spark, sf_dir):
    """Cards that a scrolled page shows again count once, where they came first."""
    k = F.col("event_id")
    cards = table(spark, sf_dir, "events").select(F.concat(F.lit("k"), (k % 997).cast("string")).alias("key"), F.floor(k / 50).cast("bigint").alias("page"), (k % 50).alias("pos"), "value")
    return payloads.first_wins(cards, "key", ["page", "pos"]).select("key", "page", "pos", "value")


@query("SELECT event_type AS grp, count(*) AS records, count(DISTINCT user_id) AS unique_keys, max(event_id % 12) AS pages, max(event_id % 400) AS source_total_items FROM events GROUP BY event_type", on_listings=False)
def unique_counters(spark, sf_dir):
    k = F.col("event_id")
    return captures.listing_summary(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("grp")), "user_id", k % 12, k % 400)


_JOBS = "SELECT c_mktsegment AS batch, c_custkey AS job, 's' || (c_custkey % 3) AS source, 'r' || c_custkey AS run_id, CASE c_custkey % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'no_inventory' ELSE 'pass' END AS job_status, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE CAST(c_custkey % 4 = 0 AS INTEGER) END AS exit_code FROM customer"


def jobs(spark, sf_dir):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    exit_code = F.when(seg == "AUTOMOBILE", F.lit(None).cast("int")).when(seg == "BUILDING", 0).otherwise((k % 4 == 0).cast("int"))
    status = F.when(k % 4 == 0, "fail").when(k % 4 == 1, "no_inventory").otherwise("pass")
    return table(spark, sf_dir, "customer").select(seg.alias("batch"), k.alias("job"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), F.concat(F.lit("r"), k.cast("string")).alias("run_id"), status.alias("job_status"), exit_code.alias("exit_code"))


@query(f"WITH j AS ({_JOBS}) SELECT batch, count(*) AS jobs, count(exit_code) AS ran, CASE WHEN count(exit_code) = 0 THEN 'planned' WHEN count(exit_code) = count(*) AND bool_and(exit_code = 0) THEN 'pass' ELSE 'fail' END AS status FROM j GROUP BY batch UNION ALL SELECT 'none', 0, 0, 'empty'", on_listings=False)
def batch_statuses(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    per = ledger.batch_status(rows.groupBy("batch")).select("batch", "jobs", "ran", "status")
    return per.unionByName(ledger.batch_status(rows.limit(0)).select(F.lit("none").alias("batch"), "jobs", "ran", "status"))


@query(f"""WITH j AS ({_JOBS}), m AS (SELECT source, run_id, CASE WHEN job % 5 = 0 THEN 'fail' ELSE 'pass' END AS manifest_status FROM j WHERE job % 6 <> 0)
SELECT j.job, j.source, j.run_id, CASE WHEN m.manifest_status IS NULL THEN 'missing_source_manifest' WHEN job_status = 'no_inventory' THEN 'no_inventory' ELSE m.manifest_status END AS status
FROM j LEFT JOIN m ON j.source = m.source AND j.run_id = m.run_id WHERE job_status IN ('pass', 'no_inventory') AND exit_code = 0""", on_listings=False)
def job_ledger_rows(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    manifests = rows.filter(F.col("job") % 6 != 0).select("source", "run_id", F.when(F.col("job") % 5 == 0, "fail").otherwise("pass").alias("manifest_status"))
    return ledger.job_rows(rows, manifests).select("job", "source", "run_id", "status")


@query("""WITH m AS (SELECT c_mktsegment AS source, 'r' || (c_custkey // 4) AS run_id, '2026-06-0' || (c_custkey % 4 + 1) AS capture_date, c_custkey AS position FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY source, run_id ORDER BY CASE WHEN capture_date = '2026-06-03' THEN 0 ELSE 1 END, capture_date) AS nth FROM m)
SELECT source, run_id, capture_date, position FROM k WHERE nth = 1""", on_listings=False)
def preferred_manifests(spark, sf_dir):
    k = F.col("c_custkey")
    found = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("source"), F.concat(F.lit("r"), F.floor(k / 4).cast("string")).alias("run_id"), F.concat(F.lit("2026-06-0"), (k % 4 + 1).cast("string")).alias("capture_date"), k.alias("position"))
    return ledger.preferred_manifest(found, F.lit("2026-06-03")).select("source", "run_id", "capture_date", "position")


@query("""SELECT c_custkey, CASE WHEN t = 0 AND a THEN 'no_inventory' WHEN NOT a THEN 'capture_failed' WHEN NOT b THEN 'contract_failed' WHEN NOT c THEN 'coverage_failed' WHEN d THEN 'pass' ELSE 'quality_failed' END AS status
FROM (SELECT c_custkey, c_custkey % 2 = 0 AS a, c_custkey % 3 <> 0 AS b, c_custkey % 5 <> 0 AS c, c_custkey % 7 <> 0 AS d, c_custkey % 11 AS t FROM customer)""", on_listings=False)
def capture_run_status(spark, sf_dir):
    k = F.col("c_custkey")
    status = captures.run_status(k % 2 == 0, k % 3 != 0, k % 5 != 0, k % 7 != 0, k % 11)
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(status, F.lit("quality_failed")).alias("status"))


_MANIFESTS = """SELECT c_mktsegment AS source, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'r' || c_custkey END AS run_id, CASE WHEN c_custkey % 2 = 0 THEN 'incremental' ELSE 'smoke' END AS kind, c_custkey % 3 <> 0 AS ok, c_custkey % 5 <> 0 AS coverage_ok, c_custkey % 7 AS listing_records,
  CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE c_custkey % 7 END AS quality_records, CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE c_custkey % 7 END AS pricing_ready, CASE WHEN c_custkey % 19 = 0 THEN 2 END AS quarantined, c_custkey % 4 AS detail_requested, CAST(NULL AS BIGINT) AS detail_attempted,
  c_custkey % 3 AS detail_successful, CASE WHEN c_custkey % 23 = 0 THEN 1 ELSE 0 END AS detail_failed, c_custkey / CAST(8 AS DOUBLE) AS duration_seconds FROM customer"""


@query(f"""WITH m AS ({_MANIFESTS}) SELECT source, coalesce(run_id, 'unknown') AS run_id, kind, CASE WHEN kind = 'incremental' THEN CASE WHEN listing_records > 0 AND coverage_ok AND quality_records = listing_records AND pricing_ready = listing_records AND coalesce(quarantined, 0) = 0 AND detail_failed = 0 THEN 'pass' ELSE 'fail' END WHEN ok THEN 'pass' ELSE 'fail' END AS status,
round_even(duration_seconds, 3) AS duration_seconds, listing_records, CAST(quality_records AS BIGINT) AS quality_records, CAST(pricing_ready AS BIGINT) AS pricing_ready, CAST(coalesce(quarantined, 0) AS BIGINT) AS quarantined, detail_requested, CAST(0 AS BIGINT) AS detail_attempted, detail_successful, CAST(detail_failed AS BIGINT) AS detail_failed FROM m""", on_listings=False)
def run_manifest_rows(spark, sf_dir):
    k = F.col("c_custkey")
    given = {
        "source": F.col("c_mktsegment"), "run_id": F.when(k % 13 != 0, F.concat(F.lit("r"), k.cast("string"))), "kind": F.when(k % 2 == 0, "incremental").otherwise("smoke"), "ok": k % 3 != 0, "coverage_ok": k % 5 != 0, "listing_records": k % 7,
        "quality_records": F.when(k % 11 == 0, 0).otherwise(k % 7), "pricing_ready": F.when(k % 17 == 0, 1).otherwise(k % 7), "quarantined": F.when(k % 19 == 0, 2), "detail_requested": k % 4, "detail_attempted": F.lit(None).cast("bigint"), "detail_successful": k % 3,
        "detail_failed": F.when(k % 23 == 0, 1).otherwise(0), "duration_seconds": k / F.lit(8.0),
    }
    return manifests.run_manifests(table(spark, sf_dir, "customer").select(*[v.alias(n) for n, v in given.items()]))


# --- splits, stability, importances ---------------------------------------------------------------------


@query("WITH k AS (SELECT record_key, row_number() OVER (ORDER BY record_key DESC) AS nth, count(*) OVER () AS n FROM listings) SELECT record_key, CASE WHEN nth <= greatest(1, least(n - 1, round_even(CAST(n * 0.2 AS DOUBLE), 0))) THEN 'test' ELSE 'train' END AS baseline_split FROM k")
def fallback_split(spark, sf_dir):
    """A hash rule that puts nothing aside: the last keys in order become the test."""
    return baseline.split_with_fallback(listings(spark, sf_dir), F.lit(False), 0.2, "record_key").select("record_key", "baseline_split")


_MEASURES = """count(*) AS n, round_even(avg(abs(e)), 4) AS mae, round_even(sqrt(avg(e * e)), 4) AS rmse, round_even(avg(abs(e) / greatest(abs(a), 1.0)) * 100, 4) AS mape_pct, round_even(median(abs(e)), 4) AS median_absolute_error, round_even(avg(e), 4) AS mean_error,
  round_even(median(e), 4) AS median_error, round_even(avg(CASE WHEN e < 0 THEN 1.0 ELSE 0.0 END) * 100, 4) AS underprediction_pct, round_even(1 - sum(e * e) / (count(*) * var_pop(a)), 4) AS r2"""
_ERRORS = ", x AS (SELECT p.*, CAST(actual_price_inr AS DOUBLE) AS a, CAST(predicted_price_inr - actual_price_inr AS DOUBLE) AS e, t.brand, t.model, t.city, t.fuel_type, t.transmission, t.model_year, t.ownership FROM pred p JOIN test t ON p.record_key = t.record_key)"
_SEGMENTS = ("source", "prediction_level", "brand", "model", "city", "fuel_type", "transmission", "model_year", "ownership")


def errors(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    found = baseline.predict(test, baseline.group_medians(train), 5, "record_key")
    return found.join(test.select("record_key", *[s for s in _SEGMENTS if s != "prediction_level"]), "record_key")


@query(LADDER + _ERRORS + f" SELECT {_MEASURES} FROM x")
def all_regression_metrics(spark, sf_dir):
    return errors(spark, sf_dir).agg(*metrics.regression_metrics(F.col("actual_price_inr"), F.col("predicted_price_inr")))


@query(LADDER + _ERRORS + " " + " UNION ALL ".join(f"SELECT '{s}' AS segment, coalesce(CAST({s} AS VARCHAR), 'unknown') AS value, {_MEASURES} FROM x GROUP BY 2 HAVING count(*) >= 20" for s in _SEGMENTS))
def all_segment_metrics(spark, sf_dir):
    return metrics.segment_metrics(errors(spark, sf_dir), list(_SEGMENTS), F.col("actual_price_inr"), F.col("predicted_price_inr"))


_SEEDS = ("split_v1", "split_v2", "split_v3")
_OF_SEED = "(" + LADDER + " SELECT round_even(avg(absolute_percentage_error) * 100, 6) AS mape FROM pred)"


@query(" WITH ".strip() + " m AS (" + " UNION ALL ".join("SELECT * FROM " + _OF_SEED.replace(SEED, s) for s in _SEEDS) + """) SELECT count(*) AS runs, round_even(avg(mape), 4) AS mean, round_even(stddev_samp(mape), 4) AS std, round_even(min(mape), 4) AS min, round_even(quantile_cont(mape, 0.25), 4) AS p25,
round_even(quantile_cont(mape, 0.5), 4) AS p50, round_even(quantile_cont(mape, 0.75), 4) AS p75, round_even(max(mape), 4) AS max, round_even(avg(CASE WHEN mape <= 10 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate,
CASE WHEN avg(CASE WHEN mape <= 10 THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'stable' WHEN avg(CASE WHEN mape <= 10 THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'mostly_stable' ELSE 'unstable' END AS status FROM m""")
def stability_over_seeds(spark, sf_dir):
    """The mean percentage error of the ladder over splits by three seeds."""
    runs = None
    for seed in _SEEDS:
        train, test = halves(spark, sf_dir, seed)
        one = baseline.predict(test, baseline.group_medians(train), 5, "record_key").agg(F.bround(F.avg("absolute_percentage_error") * 100, 6).alias("mape"))
        runs = one if runs is None else runs.unionByName(one)
    return metrics.stability(runs, "mape")


@query("""WITH i AS (SELECT p_brand AS feature, CAST(round_even(avg(p_retailprice), 4) AS DOUBLE) AS importance FROM part GROUP BY 1), m AS (SELECT * FROM (VALUES ('Brand#11', 'engineered', 'first brand'), ('Brand#22', 'raw', 'second brand')) v(feature, kind, meaning))
SELECT i.feature, importance, coalesce(kind, 'unknown') AS kind, meaning, row_number() OVER (ORDER BY importance DESC, i.feature) AS place FROM i LEFT JOIN m ON i.feature = m.feature""", on_listings=False)
def importance_with_metadata(spark, sf_dir):
    found = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.bround(F.avg("p_retailprice"), 4).cast("double").alias("importance"))
    meta = spark.createDataFrame([("Brand#11", "engineered", "first brand"), ("Brand#22", "raw", "second brand")], "feature string, kind string, meaning string")
    return profiling.described(found, meta)


# --- external files -------------------------------------------------------------------------------------

EXTERNAL = """WITH one AS (SELECT p_partkey AS k, CAST(p_partkey % 900 AS VARCHAR) AS id, p_name AS car_name, CAST(2000 + p_size % 22 AS VARCHAR) AS yr_mfr, CASE p_partkey % 4 WHEN 0 THEN 'petrol' WHEN 1 THEN 'Diesel' WHEN 2 THEN 'petrol & cng' ELSE 'electric' END AS fuel_type,
  CAST(p_size * 1000 AS VARCHAR) || '.7' AS kms_run, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS sale_price, ' new delhi' AS city, CASE WHEN p_partkey % 2 = 0 THEN 'manual' ELSE 'automatic' END AS transmission, CASE WHEN p_partkey % 5 = 0 THEN 'NA' ELSE p_type END AS variant,
  CASE WHEN p_partkey % 6 = 0 THEN 'False' ELSE 'True' END AS assured_buy, CASE p_partkey % 7 WHEN 0 THEN 'customer_to_customer' WHEN 1 THEN 'C2C' ELSE 'inspected' END AS source, CASE p_partkey % 3 WHEN 0 THEN 'Wagon-R-1-0' WHEN 1 THEN 'alto' ELSE 'swift dzire 1.2' END AS model, CAST(p_size % 3 + 1 AS VARCHAR) AS total_owners,
  CASE WHEN p_partkey % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM part), raw AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE k % 10 = 0), ext AS (SELECT k, split, 'true_value_external_kaggle_' || split || '_' || id AS listing_key, 'New Delhi' AS city, 'Maruti' AS brand, CASE k % 3 WHEN 0 THEN 'Wagon R' WHEN 1 THEN 'Alto' ELSE 'Swift Dzire' END AS model, CASE WHEN variant <> 'NA' THEN variant END AS variant, CAST(yr_mfr AS INTEGER) AS model_year,
  CASE k % 4 WHEN 0 THEN 'petrol' WHEN 1 THEN 'diesel' WHEN 2 THEN 'petrol_cng' ELSE 'electric' END AS fuel_type, transmission, CAST(floor(CAST(kms_run AS DOUBLE)) AS BIGINT) AS km_driven, CAST(total_owners AS INTEGER) AS ownership, 'MH12' AS registration_code, CAST(sale_price AS BIGINT) AS listed_price_inr,
  concat_ws(',', CASE WHEN k % 7 < 2 THEN 'source_channel_customer_to_customer' END, CASE WHEN k % 6 = 0 THEN 'assured_buy_false' END) AS reasons FROM raw)"""


def external_rows(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    given = {
        "id": k % 900, "car_name": F.col("p_name"), "yr_mfr": 2000 + size % 22, "fuel_type": F.when(k % 4 == 0, "petrol").when(k % 4 == 1, "Diesel").when(k % 4 == 2, "petrol & cng").otherwise("electric"),
        "kms_run": F.concat((size * 1000).cast("string"), F.lit(".7")), "sale_price": F.floor("p_retailprice").cast("bigint"), "city": F.lit(" new delhi"), "transmission": F.when(k % 2 == 0, "manual").otherwise("automatic"),
        "variant": F.when(k % 5 == 0, "NA").otherwise(F.col("p_type")), "assured_buy": F.when(k % 6 == 0, "False").otherwise("True"), "source": F.when(k % 7 == 0, "customer_to_customer").when(k % 7 == 1, "C2C").otherwise("inspected"), "make": F.lit("maruti"),
        "model": F.when(k % 3 == 0, "Wagon-R-1-0").when(k % 3 == 1, "alto").otherwise("swift dzire 1.2"), "total_owners": size % 3 + 1, "rto": F.lit(" mh12 "),
    }
    one = table(spark, sf_dir, "part").select(k.alias("k"), *[given.get(c, F.lit(None)).cast("string").alias(c) for c in external.COLUMNS], F.when(k % 2 == 0, "train").otherwise("test").alias("split"))
    return one.unionByName(one.filter("k % 10 = 0"))


@query(EXTERNAL + " SELECT listing_key, split, city, brand, model, variant, model_year, fuel_type, transmission, km_driven, ownership, registration_code, listed_price_inr, reasons FROM ext", on_listings=False)
def external_canonical(spark, sf_dir):
    return external.canonical(external_rows(spark, sf_dir)).drop("source").withColumn("reasons", F.array_join("reasons", ","))


@query(EXTERNAL + " SELECT model, count(*) AS n, CAST(sum(listed_price_inr) AS BIGINT) AS total FROM ext WHERE reasons = '' GROUP BY model", on_listings=False)
def external_trusted(spark, sf_dir):
    return external.trusted(external.canonical(external_rows(spark, sf_dir))).groupBy("model").agg(F.count("*").alias("n"), F.sum("listed_price_inr").alias("total"))


@query(EXTERNAL + " SELECT unnest(string_split(reasons, ',')) AS name, count(*) AS n FROM ext WHERE reasons <> '' GROUP BY 1", on_listings=False)
def external_quarantine_counts(spark, sf_dir):
    return quality.histogram(external.canonical(external_rows(spark, sf_dir)), "reasons")


@query(EXTERNAL + """ SELECT count(*) AS n, count(id) - count(DISTINCT id) AS duplicate_ids, count(*) - count(DISTINCT (id, car_name, yr_mfr, fuel_type, kms_run, sale_price, transmission, variant, assured_buy, source, model, total_owners)) AS duplicate_rows,
count(*) - count(DISTINCT (car_name, yr_mfr, fuel_type, kms_run, sale_price, transmission, variant)) AS duplicate_core_rows FROM raw""", on_listings=False)
def external_raw_profile(spark, sf_dir):
    return external.raw_profile(external_rows(spark, sf_dir))


@query(EXTERNAL + """, t AS (SELECT * FROM ext WHERE reasons = ''), f AS (SELECT count(*) AS n, count(DISTINCT listing_key) AS d FROM t)
SELECT 'source_only' AS check_name, 'pass' AS status FROM f UNION ALL SELECT 'listing_keys_are_unique', CASE WHEN n = d THEN 'pass' ELSE 'fail' END FROM f UNION ALL SELECT 'required_complete', 'pass' FROM f UNION ALL SELECT 'price_positive', 'pass' FROM f""", on_listings=False)
def external_validation(spark, sf_dir):
    rows = external.trusted(external.canonical(external_rows(spark, sf_dir)))
    return external.validate(rows, "true_value_external_kaggle")


def lineage(spark, sf_dir):
    live = listings(spark, sf_dir).filter(F.col("source") == "ASIA").withColumn("listing_key", F.col("record_index").cast("string"))
    rows = external.trusted(external.canonical(external_rows(spark, sf_dir).filter("k % 10 <> 0")))
    return combined.combined(live, rows, 1997, 2021)


_COMBINED = EXTERNAL + """, both_ AS (SELECT 'live_' || record_index AS listing_key, 'live' AS dataset_origin, 1997 AS market_snapshot_year, source, city, brand, model, variant, CAST(model_year AS VARCHAR) AS model_year, fuel_type, listed_price_inr FROM listings WHERE source = 'ASIA'
UNION ALL SELECT 'external_' || listing_key, 'external', 2021, 'true_value_external_kaggle', city, brand, model, variant, CAST(model_year AS VARCHAR), fuel_type, listed_price_inr FROM ext WHERE reasons = '' AND k % 10 <> 0)"""


@query(_COMBINED + " SELECT listing_key, dataset_origin, market_snapshot_year, source, city, brand, model, variant, model_year, fuel_type, listed_price_inr FROM both_")
def combined_rows(spark, sf_dir):
    out = lineage(spark, sf_dir).withColumn("model_year", F.col("model_year").cast("string"))
    return out.select("listing_key", "dataset_origin", "market_snapshot_year", "source", "city", "brand", "model", "variant", "model_year", "fuel_type", "listed_price_inr")


@query(_COMBINED + """, f AS (SELECT count(*) AS n, count(DISTINCT listing_key) AS d, count(*) FILTER (coalesce(listed_price_inr, 0) <= 0) AS z FROM both_)
SELECT 'rows_present' AS check_name, CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END AS status FROM f UNION ALL SELECT 'listing_keys_are_unique', CASE WHEN n = d THEN 'pass' ELSE 'fail' END FROM f UNION ALL SELECT 'origins_known', 'pass' FROM f
UNION ALL SELECT 'required_complete', 'pass' FROM f UNION ALL SELECT 'price_positive', CASE WHEN z = 0 THEN 'pass' ELSE 'fail' END FROM f""")
def combined_checks(spark, sf_dir):
    return combined.validation(lineage(spark, sf_dir))


# --- scoring --------------------------------------------------------------------------------------------


@query("SELECT record_key, CASE WHEN listed_price_inr >= 10000000 THEN format('{:.2f} Cr', listed_price_inr / 10000000) WHEN listed_price_inr >= 100000 THEN format('{:.2f} L', listed_price_inr / 100000) ELSE format('{:,}', listed_price_inr) END AS shown FROM listings")
def money_texts(spark, sf_dir):
    return listings(spark, sf_dir).select("record_key", S.money_text(F.col("listed_price_inr")).alias("shown"))

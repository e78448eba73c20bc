"""Registered queries and, by the same names, SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsers as P
from ..functions import scalars as S
from ..operators import adapters, baseline, captures, features, ledger, lifecycle, metrics, pricing_model, profiling, quality
from ..sources.tables import LISTINGS_SQL, listings, scratch, table
from ..streaming import entities as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
YEAR, SEED = 1998, "split_v1"
CUT = "1996-01"


def query(sql: str | None = None, on_listings: bool = True):
    """Register a function under its name; ``sql`` may build on the CTE ``listings``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            if on_listings:
                text = f"WITH {LISTINGS_SQL.strip()}{', ' + text[5:] if text.startswith('WITH ') else ' ' + text}"
            ORACLE_SQL[f.__name__] = text
        return f

    return add


# --- sightings of events: the flagship ----------------------------------------------------------------

EVENTS_SQL = "SELECT event_id, user_id || '|' || event_type AS listing_key, event_type AS source, CAST(user_id AS VARCHAR) AS run_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS captured_at, value FROM events"


def sightings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("record_index"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("listing_key"), F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("run_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("captured_at"), F.date_format("ts", "yyyy-MM-dd").alias("capture_date"), "value")


@query(f"""WITH e AS ({EVENTS_SQL})
SELECT listing_key, count(*) AS observation_count, min(captured_at) AS first_seen_at, max(captured_at) AS last_seen_at, count(DISTINCT substr(captured_at, 1, 10)) AS n_dates,
  max_by(source, captured_at || lpad(CAST(event_id AS VARCHAR), 20, '0')) AS source, max_by(value, captured_at || lpad(CAST(event_id AS VARCHAR), 20, '0')) AS value
FROM e GROUP BY listing_key""", on_listings=False)  # fmt: skip
def listing_entities(spark, sf_dir):
    out = lifecycle.entities(sightings(spark, sf_dir), ("source", "value"))
    return out.select("listing_key", "observation_count", "first_seen_at", "last_seen_at", F.size("capture_dates").cast("bigint").alias("n_dates"), "source", "value")


@query(f"""WITH e AS ({EVENTS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY listing_key ORDER BY captured_at DESC, run_id DESC, event_id DESC) AS nth FROM e)
SELECT listing_key, event_id AS record_index, source, captured_at, value FROM r WHERE nth = 1""", on_listings=False)
def latest_observation(spark, sf_dir):
    return lifecycle.latest_rows(sightings(spark, sf_dir)).select("listing_key", "record_index", "source", "captured_at", "value")


@query(f"WITH e AS ({EVENTS_SQL}) SELECT listing_key, count(*) AS observation_count, min(captured_at) AS first_seen_at, max(captured_at) AS last_seen_at FROM e GROUP BY listing_key", on_listings=False)
def stream_listing_entities(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    prepare = lambda df: df.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("listing_key"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("captured_at"))
    return stream.stream_entities(spark, sf_dir, schema, scratch(spark, "entities"), "listing_key", "captured_at", scratch(spark, "entities-log"), prepare, glob="events.parquet")


# --- identity -----------------------------------------------------------------------------------------

IDENTITY_SQL = """
keyed AS (
  SELECT *, CASE WHEN listing_url IS NOT NULL THEN 'listing_url' WHEN source_listing_id IS NOT NULL THEN 'source_listing_id' ELSE 'core_fields' END AS basis,
    CASE WHEN listing_url IS NOT NULL THEN 'https://cars.example' || replace(replace(substr(listing_url, 21), '/?q=1', ''), '//', '/')
      WHEN source_listing_id IS NOT NULL THEN lower(source_listing_id)
      ELSE concat_ws('|', tok(city), tok(brand), tok(model), tok(coalesce(variant, '')), model_year, listed_price_inr, km_driven) END AS value
  FROM listings
), identified AS (SELECT *, 'listing_' || substr(sha256(tok(source) || '|' || basis || '|' || value), 1, 16) AS listing_key FROM keyed)"""


def _tok(sql: str) -> str:
    """tok(x) spelt out: lower-case letters and digits with single blanks between."""
    while "tok(" in sql:
        start = sql.index("tok(")
        depth, at = 1, start + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        sql = f"{sql[:start]}trim(regexp_replace(lower({sql[start + 4 : at - 1]}), '[^a-z0-9]+', ' ', 'g')){sql[at:]}"
    return sql


IDENTIFIED = "WITH " + _tok(IDENTITY_SQL.strip())
FINGERPRINT = IDENTIFIED + _tok(""", printed AS (
  SELECT *, CASE WHEN variant IS NULL OR ownership IS NULL OR registration_code IS NULL OR tok(variant) = '' THEN ''
    ELSE 'vehicle_' || substr(sha256(concat_ws('|', tok(brand), tok(city), fuel_type, km_driven // 5000 * 5000, tok(model), ownership, listed_price_inr // 50000 * 50000, lower(registration_code), transmission, tok(variant), model_year)), 1, 16) END AS vehicle_fingerprint
  FROM identified)""")


def identified(spark, sf_dir):
    return lifecycle.with_fingerprint(lifecycle.with_identity(listings(spark, sf_dir)))


@query(IDENTIFIED + " SELECT record_index, basis AS listing_identity_basis, value AS listing_identity_value, listing_key FROM identified")
def listing_identity(spark, sf_dir):
    return lifecycle.with_identity(listings(spark, sf_dir)).select("record_index", "listing_identity_basis", "listing_identity_value", "listing_key")


@query(FINGERPRINT + " SELECT record_index, vehicle_fingerprint FROM printed")
def vehicle_fingerprint(spark, sf_dir):
    return identified(spark, sf_dir).select("record_index", "vehicle_fingerprint")


@query(FINGERPRINT + """ SELECT vehicle_fingerprint, count(*) AS observation_count, count(DISTINCT listing_key) AS listing_key_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(DISTINCT listing_key, ',' ORDER BY listing_key) AS listing_keys
FROM printed WHERE vehicle_fingerprint <> '' GROUP BY vehicle_fingerprint HAVING count(DISTINCT listing_key) > 1""")
def vehicle_duplicate_groups(spark, sf_dir):
    groups = lifecycle.duplicate_vehicles(identified(spark, sf_dir))
    return groups.select("vehicle_fingerprint", "observation_count", "listing_key_count", F.array_join("sources", ",").alias("sources"), F.array_join("listing_keys", ",").alias("listing_keys"))


@query(IDENTIFIED + " SELECT listing_key, count(*) AS observation_count FROM identified GROUP BY listing_key HAVING count(*) > 1")
def reobserved_groups(spark, sf_dir):
    return lifecycle.with_identity(listings(spark, sf_dir)).groupBy("listing_key").agg(F.count("*").alias("observation_count")).filter("observation_count > 1")


@query(FINGERPRINT + """, k AS (SELECT source, listing_key, count(*) AS n FROM printed GROUP BY source, listing_key),
g AS (SELECT vehicle_fingerprint FROM printed WHERE vehicle_fingerprint <> '' GROUP BY 1 HAVING count(DISTINCT listing_key) > 1),
d AS (SELECT source, count(DISTINCT vehicle_fingerprint) AS n FROM printed WHERE vehicle_fingerprint IN (SELECT vehicle_fingerprint FROM g) GROUP BY source)
SELECT k.source, CAST(sum(k.n) AS BIGINT) AS records, count(*) AS unique_listing_keys, CAST(sum(CASE WHEN k.n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS reobserved_listing_groups, coalesce(max(d.n), 0) AS possible_vehicle_duplicate_groups
FROM k LEFT JOIN d ON k.source = d.source GROUP BY k.source""")
def lifecycle_totals_by_source(spark, sf_dir):
    return lifecycle.totals_by_source(identified(spark, sf_dir))


@query(FINGERPRINT + """, k AS (SELECT listing_key, count(*) AS n FROM printed GROUP BY 1), g AS (SELECT vehicle_fingerprint FROM printed WHERE vehicle_fingerprint <> '' GROUP BY 1 HAVING count(DISTINCT listing_key) > 1)
SELECT CAST(sum(n) AS BIGINT) AS records_total, count(*) AS unique_listing_keys, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS reobserved_listing_groups, (SELECT count(*) FROM g) AS possible_vehicle_duplicate_groups FROM k""")
def lifecycle_totals(spark, sf_dir):
    return lifecycle.totals(identified(spark, sf_dir))


@query(FINGERPRINT + """ SELECT count(*) AS observations, 'by_listing_key' AS rule, count(DISTINCT listing_key) AS identities FROM printed UNION ALL SELECT count(*), 'by_source_id', count(DISTINCT source_listing_id) FROM printed
UNION ALL SELECT count(*), 'by_vehicle', count(DISTINCT vehicle_fingerprint) FROM printed""")
def identity_rule_comparison(spark, sf_dir):
    return lifecycle.identity_comparison(identified(spark, sf_dir), {"by_listing_key": F.col("listing_key"), "by_source_id": F.col("source_listing_id"), "by_vehicle": F.col("vehicle_fingerprint")})


SPLIT = f"CAST(('0x' || substr(sha256('{SEED}|' || record_key), 1, 12)) AS BIGINT) / 281474976710655.0 < 0.2"


@query(f"SELECT record_key, CASE WHEN {SPLIT} THEN 'test' ELSE 'train' END AS baseline_split FROM listings")
def hash_split(spark, sf_dir):
    test = S.in_test(SEED, 0.2, F.col("record_key"))
    return baseline.split_with_fallback(listings(spark, sf_dir), test, 0.2, "record_key").select("record_key", "baseline_split")


@query("""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')) || regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g'), '/$', ''), '^$', '') AS normal_url FROM pages""", on_listings=False)
def normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.normal_url(F.col("url")).alias("normal_url"))


# --- quality ------------------------------------------------------------------------------------------

_REASONS = [
    ("missing_listing_identity", "listing_url IS NULL AND source_listing_id IS NULL"), ("missing_fuel_type", "fuel_type = 'unknown'"), ("missing_raw_record_hash", "TRUE"), ("missing_ingestion_run_id", "TRUE"), ("missing_parser_version", "TRUE"), ("missing_schema_version", "TRUE"),
    ("invalid_model_year", "model_year NOT BETWEEN 1990 AND 1998"), ("unknown_fuel_type", "fuel_type = 'unknown'"), ("invalid_currency", "currency <> 'INR'"), ("listing_unavailable", "NOT is_available"), ("parse_confidence_below_gold_threshold", "parse_confidence < 0.9"),
]
_JUDGED = "WITH j AS (SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _REASONS) + ") AS reasons FROM listings)"


def judged(spark, sf_dir):
    return quality.evaluate(listings(spark, sf_dir), 1997)


@query(_JUDGED + " SELECT record_index, reasons, CASE WHEN listed_price_inr < 50000 THEN 'price_below_soft_minimum' ELSE '' END AS warnings, FALSE AS silver_valid, FALSE AS pricing_ready FROM j")
def quality_flags(spark, sf_dir):
    return judged(spark, sf_dir).select("record_index", F.array_join("reasons", ",").alias("reasons"), F.array_join("warnings", ",").alias("warnings"), "silver_valid", "pricing_ready")


_PRESENT = "(CASE WHEN listing_url IS NOT NULL OR source_listing_id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN fuel_type <> 'unknown' THEN 1 ELSE 0 END + 9 + 1 - 1)"
_COMPLETE = "(CASE WHEN listing_url IS NOT NULL OR source_listing_id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN fuel_type <> 'unknown' THEN 1 ELSE 0 END + 10)"
_HIGH = "(CASE WHEN variant IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN ownership IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN registration_code IS NOT NULL THEN 1 ELSE 0 END + 1)"


@query(f"SELECT record_index, round_even({_COMPLETE} / 16.0, 4) AS required, round_even({_HIGH} / 7.0, 4) AS high_value, round_even(1 / 30.0, 4) AS optional, round_even({_COMPLETE} / CAST(16 AS DOUBLE) * 0.7 + {_HIGH} / CAST(7 AS DOUBLE) * 0.2 + 1 / CAST(30 AS DOUBLE) * 0.1, 4) AS overall FROM listings".replace("/ 16.0", "/ CAST(16 AS DOUBLE)").replace("/ 7.0", "/ CAST(7 AS DOUBLE)").replace("/ 30.0", "/ CAST(30 AS DOUBLE)"))
def completeness_scores(spark, sf_dir):
    return judged(spark, sf_dir).select("record_index", "required", "high_value", "optional", "overall")


@query(_JUDGED + " SELECT unnest(string_split(reasons, ',')) AS name, count(*) AS n FROM j GROUP BY 1")
def quarantine_reason_counts(spark, sf_dir):
    return quality.histogram(judged(spark, sf_dir), "reasons")


@query(f"SELECT count(*) AS total, CAST(0 AS BIGINT) AS silver, CAST(0 AS BIGINT) AS pricing_ready, count(*) AS quarantined, round_even(avg(round_even({_COMPLETE} / CAST(16 AS DOUBLE), 4)), 4) AS required_avg, 'FAIL' AS status FROM listings")
def quality_run_summary(spark, sf_dir):
    return quality.run_status(quality.run_summary(judged(spark, sf_dir))).select("total", "silver", "pricing_ready", "quarantined", "required_avg", "status")


@query("""SELECT l.record_index, l.source, CASE WHEN g.kind IS NULL THEN 'unknown_source' WHEN g.priority >= 90 OR g.role LIKE 'research_only%' THEN 'source_not_mvp_eligible' ELSE '' END AS policy, coalesce(g.kind = 'classified', FALSE) AS classified
FROM listings l LEFT JOIN (VALUES ('ASIA', 'primary', 1, 'dealer'), ('EUROPE', 'research_only_first', 2, 'classified'), ('AFRICA', 'secondary', 95, 'dealer')) g(source, role, priority, kind) ON l.source = g.source""")
def source_policy_join(spark, sf_dir):
    registry = spark.createDataFrame([("ASIA", "primary", 1, "dealer"), ("EUROPE", "research_only_first", 2, "classified"), ("AFRICA", "secondary", 95, "dealer")], "source string, role string, priority int, kind string")
    out = quality.evaluate(listings(spark, sf_dir), 1997, registry)
    policy = F.coalesce(F.get(F.array_intersect("reasons", F.array(F.lit("unknown_source"), F.lit("source_not_mvp_eligible"))), F.lit(0)), F.lit(""))
    return out.select("record_index", "source", policy.alias("policy"), F.array_contains("warnings", "classified_source").alias("classified"))


_FIELDS = ["variant", "ownership", "registration_code", "listing_url", "source_listing_id", "fuel_type", "city"]
_present = lambda f: f"({f} IS NOT NULL AND lower(trim(CAST({f} AS VARCHAR))) NOT IN ('', 'unknown'))"


@query(" UNION ALL ".join(f"SELECT 'listing' AS grp, '{f}' AS field, count(*) FILTER ({_present(f)}) AS present, count(*) AS total, round_even(count(*) FILTER ({_present(f)}) / CAST(count(*) AS DOUBLE), 4) AS ratio FROM listings" for f in _FIELDS))
def field_profile(spark, sf_dir):
    return quality.field_profile(listings(spark, sf_dir), {"listing": _FIELDS})


_SIDE = "round_even(count(*) FILTER (source = '{s}' AND {p}) / CAST(count(*) FILTER (source = '{s}') AS DOUBLE), 4)"
_CMP = "SELECT *, round_even(greatest(\"ASIA\", \"EUROPE\") - least(\"ASIA\", \"EUROPE\"), 4) AS spread, CASE WHEN greatest(\"ASIA\", \"EUROPE\") - least(\"ASIA\", \"EUROPE\") >= 0.5 THEN 'large_gap' WHEN least(\"ASIA\", \"EUROPE\") = 1.0 THEN 'complete' WHEN greatest(\"ASIA\", \"EUROPE\") = 0.0 THEN 'missing' ELSE 'partial' END AS note FROM p"


@query("WITH p AS (" + " UNION ALL ".join("SELECT '" + f + "' AS field, " + ", ".join(_SIDE.format(s=s, p=_present(f)) + f' AS "{s}"' for s in ("ASIA", "EUROPE")) + " FROM listings" for f in _FIELDS) + ") " + _CMP)
def multi_source_field_comparison(spark, sf_dir):
    rows = listings(spark, sf_dir)
    profiles = None
    for s in ("ASIA", "EUROPE"):
        one = quality.field_profile(rows.filter(F.col("source") == s), {"listing": _FIELDS}).select(F.lit(s).alias("source"), "field", "ratio")
        profiles = one if profiles is None else profiles.unionByName(one)
    return quality.compare_sources(profiles, ["ASIA", "EUROPE"])


# --- two snapshots ------------------------------------------------------------------------------------

SNAPSHOTS = IDENTIFIED + f""", c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_key ORDER BY record_index DESC) AS nth FROM identified WHERE capture_date >= '{CUT}') WHERE nth = 1),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_key ORDER BY record_index DESC) AS nth FROM identified WHERE capture_date < '{CUT}') WHERE nth = 1),
diff AS (SELECT coalesce(c.listing_key, p.listing_key) AS listing_key, CASE WHEN p.listing_key IS NULL THEN 'added' WHEN c.listing_key IS NULL THEN 'removed' ELSE 'still_active' END AS status, coalesce(c.source, p.source) AS source,
  p.source AS previous_source, c.source AS current_source, p.listed_price_inr AS previous_price_inr, c.listed_price_inr AS current_price_inr, nullif(c.listed_price_inr - p.listed_price_inr, 0) AS price_delta_inr,
  CASE WHEN p.listed_price_inr <> 0 THEN round_even(nullif(c.listed_price_inr - p.listed_price_inr, 0) / CAST(p.listed_price_inr AS DOUBLE) * 100, 2) END AS price_delta_pct, p.km_driven AS previous_km, c.km_driven AS current_km, nullif(c.km_driven - p.km_driven, 0) AS km_delta
  FROM c FULL JOIN p ON c.listing_key = p.listing_key)"""


def diff(spark, sf_dir):
    rows = lifecycle.with_identity(listings(spark, sf_dir))
    return lifecycle.diff_of_observations(rows, F.col("capture_date") >= CUT, "record_index")


@query(SNAPSHOTS + " SELECT * FROM diff")
def snapshot_diff_status(spark, sf_dir):
    return diff(spark, sf_dir)


@query(SNAPSHOTS + " SELECT listing_key, source, price_delta_inr, price_delta_pct FROM diff WHERE price_delta_inr IS NOT NULL")
def price_changes(spark, sf_dir):
    return diff(spark, sf_dir).filter("price_delta_inr IS NOT NULL").select("listing_key", "source", "price_delta_inr", "price_delta_pct")


@query(SNAPSHOTS + " SELECT listing_key, source, km_delta FROM diff WHERE km_delta IS NOT NULL ORDER BY abs(km_delta) DESC, listing_key LIMIT 20")
def km_changes(spark, sf_dir):
    return lifecycle.largest_changes(diff(spark, sf_dir), "km_delta").select("listing_key", "source", "km_delta")


@query(SNAPSHOTS + """ SELECT source, CAST(sum(pr) AS BIGINT) AS previous, CAST(sum(cu) AS BIGINT) AS current, CAST(sum(ad) AS BIGINT) AS added, CAST(sum(re) AS BIGINT) AS removed, CAST(sum(st) AS BIGINT) AS still_active, CAST(sum(pc) AS BIGINT) AS price_changes, CAST(sum(kc) AS BIGINT) AS km_changes FROM (
SELECT current_source AS source, 0 AS pr, 1 AS cu, CAST(status = 'added' AS INT) AS ad, 0 AS re, CAST(status = 'still_active' AS INT) AS st, CAST(price_delta_inr IS NOT NULL AS INT) AS pc, CAST(km_delta IS NOT NULL AS INT) AS kc FROM diff WHERE status <> 'removed'
UNION ALL SELECT previous_source, 1, 0, 0, CAST(status = 'removed' AS INT), 0, 0, 0 FROM diff WHERE status <> 'added') GROUP BY source""")
def diff_totals_by_source(spark, sf_dir):
    return lifecycle.diff_totals_by_source(diff(spark, sf_dir))


@query(SNAPSHOTS + """ SELECT count(*) FILTER (status <> 'added') AS previous_unique_listing_keys, count(*) FILTER (status <> 'removed') AS current_unique_listing_keys, count(*) FILTER (status = 'added') AS added_count, count(*) FILTER (status = 'removed') AS removed_count,
count(*) FILTER (status = 'still_active') AS still_active_count, count(price_delta_inr) AS price_change_count, count(km_delta) AS km_change_count, count(*) FILTER (price_delta_inr IS NOT NULL OR km_delta IS NOT NULL) AS changed_listing_count FROM diff""")
def diff_totals(spark, sf_dir):
    return lifecycle.diff_totals(diff(spark, sf_dir))


# --- ledgers ------------------------------------------------------------------------------------------

_RUNS = "SELECT c_mktsegment AS source, CAST(c_nationkey AS VARCHAR) AS run_id, CAST(c_custkey % 2 AS INTEGER) AS precedence, c_custkey AS position, CASE c_custkey % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'no_inventory' ELSE 'pass' END AS status, CAST(floor(abs(c_acctbal)) AS BIGINT) AS pricing_ready, c_custkey % 7 AS quarantined, c_custkey % 11 AS source_total_items, n_name AS city FROM customer JOIN nation ON c_nationkey = n_nationkey"
LEDGER = f"WITH runs AS ({_RUNS}), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, run_id ORDER BY precedence, position) AS nth FROM runs WHERE status <> 'fail') WHERE nth = 1)"
_SUMS = "count(*) AS source_runs, count(*) FILTER (status = 'pass') AS listing_source_runs, CAST(sum(pricing_ready) AS BIGINT) AS pricing_ready, CAST(sum(quarantined) AS BIGINT) AS quarantined, CAST(sum(source_total_items) AS BIGINT) AS source_total_signal, count(*) FILTER (status = 'no_inventory') AS no_inventory_source_runs"


def runs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return c.select(F.col("c_mktsegment").alias("source"), F.col("c_nationkey").cast("string").alias("run_id"), (k % 2).cast("int").alias("precedence"), k.alias("position"), F.when(k % 5 == 0, "fail").when(k % 5 == 1, "no_inventory").otherwise("pass").alias("status"), F.floor(F.abs("c_acctbal")).cast("bigint").alias("pricing_ready"), (k % 7).alias("quarantined"), (k % 11).alias("source_total_items"), F.col("n_name").alias("city"))


@query(LEDGER + " SELECT source, run_id, precedence, position, status, pricing_ready FROM kept", on_listings=False)
def ledger_first_wins(spark, sf_dir):
    return ledger.ledger(runs(spark, sf_dir)).select("source", "run_id", "precedence", "position", "status", "pricing_ready")


@query(LEDGER + f" SELECT source, {_SUMS} FROM kept GROUP BY ROLLUP(source)", on_listings=False)
def ledger_rollup(spark, sf_dir):
    return ledger.rollup(ledger.ledger(runs(spark, sf_dir)))


@query(LEDGER + f" SELECT source, {_SUMS} FROM kept GROUP BY source", on_listings=False)
def ledger_totals_by_source(spark, sf_dir):
    return ledger.totals_by_source(ledger.ledger(runs(spark, sf_dir)))


@query(LEDGER + """, t AS (SELECT count(*) AS n, count(*) FILTER (status = 'pass') AS p, count(DISTINCT (source, run_id)) AS d, sum(quarantined) AS q FROM kept)
SELECT 'runs_are_unique' AS check_name, CASE WHEN n = d THEN 'pass' ELSE 'fail' END AS status FROM t UNION ALL SELECT 'all_runs_list', CASE WHEN n = p THEN 'pass' ELSE 'fail' END FROM t UNION ALL SELECT 'nothing_quarantined', CASE WHEN q = 0 THEN 'pass' ELSE 'fail' END FROM t""", on_listings=False)
def manifest_checks(spark, sf_dir):
    kept = ledger.ledger(runs(spark, sf_dir))
    figures = kept.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pass").alias("p"), F.count_distinct("source", "run_id").alias("d"), F.sum("quarantined").alias("q"))
    return ledger.checks(figures, {"runs_are_unique": F.col("n") == F.col("d"), "all_runs_list": F.col("n") == F.col("p"), "nothing_quarantined": F.col("q") == 0})


@query(LEDGER + " SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(DISTINCT city, ',' ORDER BY city) AS cities FROM kept", on_listings=False)
def scope_sets(spark, sf_dir):
    s = ledger.scope(ledger.ledger(runs(spark, sf_dir)))
    return s.select(F.array_join("source_set", ",").alias("sources"), F.array_join("city_set", ",").alias("cities"))


@query("""WITH n AS (SELECT count(*) AS current FROM customer), s AS (SELECT * FROM (VALUES ('original_baseline_scope', 909), ('small_scale', 2500), ('recommended', 5000), ('stretch', 10000)) v(scenario, r) UNION ALL SELECT 'current_checkpoint_size', current FROM n),
x AS (SELECT scenario, CAST(r AS BIGINT) AS rows_per_snapshot, current, greatest(100000 - current, 0) AS remaining, CAST(ceil(greatest(100000 - current, 0) / CAST(r AS DOUBLE)) AS BIGINT) AS future_snapshots FROM s, n)
SELECT *, future_snapshots + 1 AS total_snapshots, current + future_snapshots * rows_per_snapshot AS projected_observations FROM x""", on_listings=False)
def scale_projection(spark, sf_dir):
    return ledger.scale_projection(table(spark, sf_dir, "customer").agg(F.count("*").alias("current")), 100_000)


_TARGETS = {"true_value": 2500, "mahindra_first_choice": 1500, "spinny": 1000}
_SOURCES = {"AUTOMOBILE": "true_value", "BUILDING": "mahindra_first_choice", "FURNITURE": "spinny"}


@query("""WITH b AS (SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'true_value' WHEN 'BUILDING' THEN 'mahindra_first_choice' WHEN 'FURNITURE' THEN 'spinny' END AS source, 8 * count(*) AS n FROM customer GROUP BY 1),
r AS (SELECT t.source, coalesce(b.n, 0) AS current_rows, CAST(t.t AS BIGINT) AS target_rows FROM (VALUES ('true_value', 2500), ('mahindra_first_choice', 1500), ('spinny', 1000)) t(source, t) LEFT JOIN b ON t.source = b.source),
g AS (SELECT *, greatest(target_rows - current_rows, 0) AS allocation_gap, greatest(current_rows - target_rows, 0) AS over_allocation, round_even(current_rows / CAST(target_rows AS DOUBLE) * 100, 2) AS fill_pct, round_even(current_rows / CAST(5000 AS DOUBLE) * 100, 2) AS current_share_pct FROM r)
SELECT *, CASE WHEN current_rows > target_rows THEN 'over_allocation' WHEN allocation_gap = 0 THEN 'allocation_met' WHEN source = 'true_value' AND fill_pct >= 95 THEN 'near_allocation' WHEN source = 'mahindra_first_choice' THEN 'capacity_constrained' WHEN source = 'spinny' THEN 'incremental_expansion_needed' ELSE 'under_allocation' END AS status,
CASE source WHEN 'spinny' THEN least(allocation_gap, 200) WHEN 'mahindra_first_choice' THEN least(allocation_gap, 300) ELSE allocation_gap END AS next_rows FROM g""", on_listings=False)
def gap_strategy(spark, sf_dir):
    by = table(spark, sf_dir, "customer").groupBy(S.mapped(_SOURCES, F.col("c_mktsegment")).alias("source")).agg((F.count("*") * 8).alias("pricing_ready"))
    return ledger.gap_strategy(by, _TARGETS, 5000)


# --- profiles -----------------------------------------------------------------------------------------


@query("SELECT coalesce(nullif(trim(variant), ''), 'unknown') AS value, count(*) AS n, round_even(count(*) / CAST((SELECT count(*) FROM listings) AS DOUBLE) * 100, 4) AS share_pct FROM listings GROUP BY 1")
def value_counts_share(spark, sf_dir):
    return profiling.value_counts(listings(spark, sf_dir), "variant")


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER ({f} IS NOT NULL AND trim(CAST({f} AS VARCHAR)) <> '') AS present, count(*) FILTER ({f} IS NULL OR trim(CAST({f} AS VARCHAR)) = '') AS missing, round_even(count(*) FILTER ({f} IS NOT NULL AND trim(CAST({f} AS VARCHAR)) <> '') / CAST(count(*) AS DOUBLE) * 100, 4) AS completeness_pct FROM listings" for f in _FIELDS))
def field_completeness(spark, sf_dir):
    return profiling.completeness(listings(spark, sf_dir), _FIELDS)


_STATS = "count({v}) AS n, round_even(CAST(min({v}) AS DOUBLE), 4) AS min, " + ", ".join("round_even(quantile_cont({v}, " + str(p) + "), 4) AS " + n for n, p in profiling.PERCENTILES.items()) + ", round_even(CAST(max({v}) AS DOUBLE), 4) AS max, round_even(avg({v}), 4) AS mean"
_NUMERIC = ["listed_price_inr", "km_driven", "model_year", "ownership"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, {_STATS.format(v=f'CAST({c} AS DOUBLE)')} FROM listings" for c in _NUMERIC))
def numeric_summary(spark, sf_dir):
    return profiling.numeric_summary(listings(spark, sf_dir), _NUMERIC)


@query(f"SELECT brand AS grp, {_STATS.format(v='listed_price_inr')} FROM listings GROUP BY brand ORDER BY n DESC, grp LIMIT 20")
def grouped_summary_topn(spark, sf_dir):
    return profiling.grouped_summary(listings(spark, sf_dir), "brand", "listed_price_inr", 20)


@query("SELECT brand, model, count(*) AS n, median(listed_price_inr) AS median_price, round_even(avg(listed_price_inr), 2) AS mean_price, median(km_driven) AS median_km, median(model_year) AS median_year FROM listings GROUP BY brand, model HAVING count(*) >= 5 ORDER BY n DESC, brand, model LIMIT 50")
def median_price_table(spark, sf_dir):
    return profiling.median_prices(listings(spark, sf_dir), ["brand", "model"], 5, 50)


@query(""" WITH v AS (SELECT 'brand' AS field, brand AS value, count(*) AS n FROM listings GROUP BY 1, 2 UNION ALL SELECT 'model', model, count(*) FROM listings GROUP BY 1, 2 UNION ALL SELECT 'variant', coalesce(nullif(trim(variant), ''), 'unknown'), count(*) FROM listings GROUP BY 1, 2)
SELECT field, count(*) AS distinct_values, count(*) FILTER (n < 30) AS rare_values, CAST(coalesce(sum(n) FILTER (n < 30), 0) AS BIGINT) AS rare_rows, max_by(value, lpad(CAST(n AS VARCHAR), 12, '0') || value) AS top_value, max(n) AS top_rows FROM v GROUP BY field""".strip())
def rare_category_coverage(spark, sf_dir):
    return profiling.category_coverage(listings(spark, sf_dir), ["brand", "model", "variant"], 30)


@query("SELECT source, count(*) AS n, count(DISTINCT city) AS cities, count(DISTINCT (brand, model)) AS brand_models, median(listed_price_inr) AS median_price, median(km_driven) AS median_km, median(model_year) AS median_year FROM listings GROUP BY source")
def source_drift_profile(spark, sf_dir):
    return profiling.drift(listings(spark, sf_dir), "source")


@query("""WITH t AS (SELECT count(*) AS n FROM listings), f AS (SELECT 'source_imbalance' AS finding, 'warning' AS severity, (SELECT max(c) FROM (SELECT count(*) AS c FROM listings GROUP BY source)) / CAST(n AS DOUBLE) * 100 AS figure, 60.0 AS lim FROM t
UNION ALL SELECT 'city_concentration', 'warning', (SELECT max(c) FROM (SELECT count(*) AS c FROM listings GROUP BY city)) / CAST(n AS DOUBLE) * 100, 20.0 FROM t
UNION ALL SELECT 'thin_groups', 'warning', coalesce((SELECT sum(c) FROM (SELECT count(*) AS c FROM listings GROUP BY brand, model) WHERE c < 5), 0), 0 FROM t
UNION ALL SELECT 'missing_ownership', 'warning', count(*) FILTER (ownership IS NULL), 0 FROM listings UNION ALL SELECT 'missing_variant', 'warning', count(*) FILTER (variant IS NULL), 0 FROM listings UNION ALL SELECT 'missing_registration_code', 'warning', count(*) FILTER (registration_code IS NULL), 0 FROM listings
UNION ALL SELECT 'future_model_year', 'blocking', count(*) FILTER (model_year > 1997), 0 FROM listings UNION ALL SELECT 'extreme_km', 'warning', count(*) FILTER (km_driven > 300000), 0 FROM listings UNION ALL SELECT 'extreme_price', 'warning', count(*) FILTER (listed_price_inr > 10000000), 0 FROM listings)
SELECT finding, severity, round_even(CAST(figure AS DOUBLE), 4) AS figure, figure > lim AS raised FROM f""")
def blind_spots(spark, sf_dir):
    return profiling.blind_spots(listings(spark, sf_dir), 1997)


_TESTS = {"price_not_positive": "coalesce(listed_price_inr, 0) <= 0", "price_below_50k": "listed_price_inr < 50000", "price_above_3m": "listed_price_inr > 3000000", "km_negative": "km_driven < 0", "km_above_300k": "km_driven > 300000", "year_before_2000": "model_year < 2000", "year_after_snapshot": "model_year > 1997", "age_negative": "1997 - model_year < 0", "owners_outside_1_5": "ownership NOT BETWEEN 1 AND 5"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER ({t}) AS violations, CASE WHEN count(*) FILTER ({t}) = 0 THEN 'pass' ELSE 'review' END AS status FROM listings" for n, t in _TESTS.items()))
def range_sanity(spark, sf_dir):
    return profiling.sanity(listings(spark, sf_dir), profiling.range_tests(1997))


@query("SELECT count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT city) AS cities, count(DISTINCT brand) AS brands, count(DISTINCT (brand, model)) AS brand_models, round_even(quantile_cont(listed_price_inr, 0.01), 4) AS price_p01, round_even(quantile_cont(listed_price_inr, 0.5), 4) AS price_p50, round_even(quantile_cont(listed_price_inr, 0.99), 4) AS price_p99 FROM listings")
def dataset_summary(spark, sf_dir):
    return profiling.dataset_summary(listings(spark, sf_dir))


# --- comparable medians -------------------------------------------------------------------------------

_LEVEL_SQL = " UNION ALL ".join(
    f"SELECT {i} AS level, '{n}' AS level_name, " + ("concat_ws('|', " + ", ".join(f"lower(trim(CAST({p} AS VARCHAR)))" for p in parts) + ")" if parts else "''") + " AS key, {cols} FROM {src} WHERE TRUE" + "".join(f" AND {p} IS NOT NULL" for p in parts)
    for i, (n, parts) in enumerate(baseline.LEVELS)
)
MEDIANS = f"WITH train AS (SELECT * FROM listings WHERE NOT ({SPLIT})), test AS (SELECT * FROM listings WHERE {SPLIT}), tk AS (" + _LEVEL_SQL.format(cols="listed_price_inr AS price", src="train") + "), medians AS (SELECT level, level_name, key, CAST(round_even(median(price), 0) AS BIGINT) AS median_price, count(*) AS n FROM tk GROUP BY 1, 2, 3)"
LADDER = MEDIANS + ", wk AS (" + _LEVEL_SQL.format(cols="record_key AS id, listed_price_inr AS actual, source, city", src="test") + """), hits AS (SELECT id, actual, source, city, m.level_name, m.median_price, m.n, row_number() OVER (PARTITION BY id ORDER BY m.level, actual, m.median_price) AS nth FROM wk JOIN medians m ON wk.level = m.level AND wk.key = m.key WHERE m.n >= 5 OR m.level_name = 'global'),
pred AS (SELECT id AS record_key, source, actual AS actual_price_inr, median_price AS predicted_price_inr, level_name AS prediction_level, n AS training_group_count, abs(actual - median_price) AS absolute_error_inr, CASE WHEN actual > 0 THEN round_even(abs(actual - median_price) / CAST(actual AS DOUBLE), 6) END AS absolute_percentage_error FROM hits WHERE nth = 1)"""
_LADDER_METRICS = "count(*) AS n, round_even(avg(absolute_error_inr), 2) AS mae, round_even(sqrt(avg(CAST(absolute_error_inr AS DOUBLE) * absolute_error_inr)), 2) AS rmse, round_even(median(absolute_error_inr), 2) AS median_absolute_error, round_even(avg(absolute_percentage_error), 6) AS mape, round_even(median(absolute_percentage_error), 6) AS median_absolute_percentage_error, round_even(count(*) FILTER (absolute_percentage_error <= 0.10) / CAST(count(absolute_percentage_error) AS DOUBLE) * 100, 2) AS within_10_pct, round_even(count(*) FILTER (absolute_percentage_error <= 0.20) / CAST(count(absolute_percentage_error) AS DOUBLE) * 100, 2) AS within_20_pct"


def halves(spark, sf_dir, seed=SEED):
    """Train and test rows, written once because several branches of a plan read them."""
    rows = listings(spark, sf_dir).select("record_key", "source", "city", "brand", "model", "variant", "model_year", "fuel_type", "transmission", "ownership", "km_driven", "listed_price_inr")
    path = scratch(spark, "halves")
    marked = rows.withColumn("is_test", S.in_test(seed, 0.2, F.col("record_key")))
    marked.write.parquet(path)  # not a folder for each side, for which every task would sort its rows
    kept = spark.read.schema(marked.schema).parquet(path)
    return kept.filter(~F.col("is_test")).drop("is_test"), kept.filter("is_test").drop("is_test")


def ladder(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return baseline.predict(test, baseline.group_medians(train), 5, "record_key").join(test.select("record_key", "source", "brand", "model", "city", "km_driven", "model_year"), "record_key")


@query(MEDIANS + " SELECT level, level_name, key, median_price, n FROM medians")
def group_medians_grouping_sets(spark, sf_dir):
    return baseline.group_medians(halves(spark, sf_dir)[0])


@query(MEDIANS + " SELECT level_name, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows_covered FROM medians GROUP BY level_name")
def group_coverage(spark, sf_dir):
    return baseline.group_coverage(baseline.group_medians(halves(spark, sf_dir)[0]))


_PRED = ("record_key", "actual_price_inr", "predicted_price_inr", "prediction_level", "training_group_count", "absolute_error_inr", "absolute_percentage_error")


@query(LADDER + f" SELECT {', '.join(_PRED)} FROM pred")
def ladder_prediction(spark, sf_dir):
    return ladder(spark, sf_dir).select(*_PRED)


@query(LADDER + f" SELECT {_LADDER_METRICS} FROM pred")
def prediction_metrics(spark, sf_dir):
    return ladder(spark, sf_dir).agg(*metrics.ladder_metrics())


@query(LADDER + f" SELECT prediction_level, {_LADDER_METRICS} FROM pred GROUP BY prediction_level")
def metrics_by_group(spark, sf_dir):
    return ladder(spark, sf_dir).groupBy("prediction_level").agg(*metrics.ladder_metrics())


@query(LADDER + " SELECT source, count(*) AS n, round_even(avg(abs(predicted_price_inr - actual_price_inr)), 4) AS mae, round_even(avg(predicted_price_inr - actual_price_inr), 4) AS mean_error, round_even(avg(CASE WHEN predicted_price_inr < actual_price_inr THEN 1.0 ELSE 0.0 END) * 100, 4) AS underprediction_pct, round_even(median(abs(predicted_price_inr - actual_price_inr)), 4) AS median_absolute_error FROM pred GROUP BY source")
def regression_metrics(spark, sf_dir):
    rows = ladder(spark, sf_dir).groupBy("source").agg(*metrics.regression_metrics(F.col("actual_price_inr"), F.col("predicted_price_inr")))
    return rows.select("source", "n", "mae", "mean_error", "underprediction_pct", "median_absolute_error")


@query(LADDER + " SELECT 'source' AS segment, source AS value, count(*) AS n, round_even(avg(abs(predicted_price_inr - actual_price_inr)), 4) AS mae FROM pred GROUP BY source HAVING count(*) >= 20 UNION ALL SELECT 'prediction_level', prediction_level, count(*), round_even(avg(abs(predicted_price_inr - actual_price_inr)), 4) FROM pred GROUP BY prediction_level HAVING count(*) >= 20")
def segment_metrics(spark, sf_dir):
    return metrics.segment_metrics(ladder(spark, sf_dir), ["source", "prediction_level"], F.col("actual_price_inr"), F.col("predicted_price_inr")).select("segment", "value", "n", "mae")


@query(LADDER + " SELECT count(*) AS n, count(*) FILTER (absolute_percentage_error * 100 <= 5) AS within_5, count(*) FILTER (absolute_percentage_error * 100 <= 10) AS within_10, count(*) FILTER (absolute_percentage_error * 100 <= 15) AS within_15, count(*) FILTER (absolute_percentage_error * 100 > 25) AS above_25 FROM pred")
def error_bands(spark, sf_dir):
    return ladder(spark, sf_dir).agg(*metrics.error_bands(F.col("absolute_percentage_error") * 100))


@query(LADDER + ", m AS (SELECT source, round_even(avg(absolute_percentage_error) * 100, 6) AS mape FROM pred GROUP BY source) SELECT count(*) AS runs, round_even(avg(mape), 4) AS mean, round_even(stddev_samp(mape), 4) AS std, round_even(min(mape), 4) AS min, round_even(quantile_cont(mape, 0.5), 4) AS p50, round_even(max(mape), 4) AS max FROM m")
def stability_summary(spark, sf_dir):
    per = ladder(spark, sf_dir).groupBy("source").agg(F.bround(F.avg("absolute_percentage_error") * 100, 6).alias("mape"))
    return metrics.stability(per, "mape").select("runs", "mean", "std", "min", "p50", "max")


_BM = "(SELECT brand, model, count(*) AS n FROM train GROUP BY 1, 2)"
WARNED = LADDER + f""", w AS (SELECT p.record_key, p.predicted_price_inr AS price, coalesce(b.n, 0) AS bm, t.km_driven, t.model_year FROM pred p JOIN test t ON p.record_key = t.record_key LEFT JOIN {_BM} b ON t.brand = b.brand AND t.model = b.model),
s AS (SELECT *, concat_ws(',', CASE WHEN bm < 10 THEN 'rare_or_unseen_brand_model' END, CASE WHEN price >= 1000000 THEN 'premium_or_high_price_segment' END, CASE WHEN km_driven > 300000 THEN 'km_outside_training_policy' END, CASE WHEN model_year < 2000 OR model_year > 2026 THEN 'model_year_outside_training_policy' END) AS warnings FROM w)"""


def warned(spark, sf_dir):
    train, _ = halves(spark, sf_dir)
    n = lambda *by: train.groupBy(*by).agg(F.count("*").alias("n_" + "_".join(by)))
    rows = ladder(spark, sf_dir)
    for by in (("brand", "model"), ("brand",), ("model",), ("city",)):
        rows = rows.join(n(*by), list(by), "left")
    said = features.segment_warnings(F.col("predicted_price_inr"), F.col("n_brand_model"), F.col("n_brand"), F.col("n_model"), F.col("n_city"))
    return rows.withColumn("warnings", said).withColumn("grade", features.confidence(F.col("warnings"), F.col("predicted_price_inr"), F.col("n_brand_model")))


@query(WARNED + " SELECT record_key, warnings FROM s")
def segment_warnings(spark, sf_dir):
    return warned(spark, sf_dir).select("record_key", F.array_join("warnings", ",").alias("warnings"))


@query(WARNED + """, g AS (SELECT *, CASE WHEN bm < 10 OR km_driven > 300000 OR model_year < 2000 OR model_year > 2026 THEN 'low' WHEN price >= 1000000 OR bm < 30 OR price < 250000 THEN 'medium' ELSE 'high' END AS confidence FROM s)
SELECT record_key, confidence, CAST(round_even(price * (1 - m), 0) AS BIGINT) AS low_inr, CAST(round_even(price * (1 + m), 0) AS BIGINT) AS high_inr FROM (SELECT *, CASE confidence WHEN 'low' THEN CAST(0.28 AS DOUBLE) WHEN 'medium' THEN CAST(0.18 AS DOUBLE) ELSE CAST(0.12 AS DOUBLE) END AS m FROM g)""")
def confidence_interval_rules(spark, sf_dir):
    p, m = F.col("predicted_price_inr"), F.col("grade.margin")
    edge = lambda x: F.bround(p * x, 0).cast("bigint")
    return warned(spark, sf_dir).select("record_key", F.col("grade.confidence").alias("confidence"), edge(1 - m).alias("low_inr"), edge(1 + m).alias("high_inr"))


# --- unions, features, encodings ----------------------------------------------------------------------


@query("SELECT 'live' AS dataset_origin, 'live_' || record_index AS combined_key, listed_price_inr FROM listings WHERE source = 'ASIA' UNION ALL SELECT 'external', 'external_' || record_index, listed_price_inr FROM listings WHERE source = 'EUROPE'")
def union_lineage(spark, sf_dir):
    rows = listings(spark, sf_dir)
    part = lambda s, o: rows.filter(F.col("source") == s).select(F.lit(o).alias("dataset_origin"), F.concat(F.lit(f"{o}_"), F.col("record_index").cast("string")).alias("combined_key"), "listed_price_inr")
    return part("ASIA", "live").unionByName(part("EUROPE", "external"))


@query("""WITH u AS (SELECT 'live_' || record_index AS k, brand, model, listed_price_inr AS p FROM listings WHERE source = 'ASIA' UNION ALL SELECT 'external_' || record_index, brand, model, listed_price_inr FROM listings WHERE source = 'EUROPE'), f AS (SELECT count(*) AS n, count(DISTINCT k) AS d, count(*) FILTER (brand IS NULL OR model IS NULL) AS m, count(*) FILTER (p IS NULL OR p = 0) AS z FROM u)
SELECT 'keys_are_unique' AS check_name, CASE WHEN n = d THEN 'pass' ELSE 'fail' END AS status FROM f UNION ALL SELECT 'required_complete', CASE WHEN m = 0 THEN 'pass' ELSE 'fail' END FROM f UNION ALL SELECT 'price_present', CASE WHEN z = 0 THEN 'pass' ELSE 'fail' END FROM f UNION ALL SELECT 'rows_present', CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END FROM f""")
def combined_validation(spark, sf_dir):
    rows = listings(spark, sf_dir)
    u = union_lineage(spark, sf_dir).select("combined_key").agg(F.count("*").alias("n"), F.count_distinct("combined_key").alias("d"))
    facts = rows.filter(F.col("source").isin("ASIA", "EUROPE")).agg(F.count_if(F.col("brand").isNull() | F.col("model").isNull()).alias("m"), F.count_if(F.coalesce("listed_price_inr", F.lit(0)) == 0).alias("z"))
    one = ledger.checks(u, {"keys_are_unique": F.col("n") == F.col("d"), "rows_present": F.col("n") > 0})
    return one.unionByName(ledger.checks(facts, {"required_complete": F.col("m") == 0, "price_present": F.col("z") == 0}))


@query(LADDER + f" SELECT CASE source WHEN 'ASIA' THEN 'live' WHEN 'EUROPE' THEN 'external' ELSE 'unknown' END AS dataset_origin, {_LADDER_METRICS} FROM pred GROUP BY 1")
def metrics_by_origin(spark, sf_dir):
    lineage = spark.createDataFrame([("ASIA", "live"), ("EUROPE", "external")], "source string, dataset_origin string")
    rows = ladder(spark, sf_dir).join(F.broadcast(lineage), "source", "left").withColumn("dataset_origin", F.coalesce("dataset_origin", F.lit("unknown")))
    return rows.groupBy("dataset_origin").agg(*metrics.ladder_metrics())


_ENCODED = "SELECT '{c}' AS field, coalesce({c}, 'unknown') AS value, count(*) AS n, sum(CAST(round(ln(1 + CAST(listed_price_inr AS DOUBLE)), 9) AS DECIMAL(20, 9))) AS s FROM listings GROUP BY 1, 2"


@query("WITH g AS (" + " UNION ALL ".join(_ENCODED.format(c=c) for c in ("brand", "model", "variant")) + ") SELECT field, value, n, round_even((CAST(s AS DOUBLE) + 10 * CAST(sum(s) OVER (PARTITION BY field) AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY field) AS DOUBLE)) / (n + 10), 6) AS encoded FROM g")
def target_encoding_smoothed(spark, sf_dir):
    return features.target_encoding(listings(spark, sf_dir), ["brand", "model", "variant"])


@query("""WITH r AS (SELECT record_index, brand AS value, CAST(record_index % 5 AS INTEGER) AS fold, CAST(round(ln(1 + CAST(listed_price_inr AS DOUBLE)), 9) AS DECIMAL(20, 9)) AS y FROM listings),
o AS (SELECT a.value, a.fold, CAST(sum(CASE WHEN b.fold <> a.fold THEN b.s ELSE 0 END) AS DOUBLE) AS os, sum(CASE WHEN b.fold <> a.fold THEN b.n ELSE 0 END) AS oc FROM (SELECT value, fold FROM r GROUP BY 1, 2) a JOIN (SELECT value, fold, sum(y) AS s, count(*) AS n FROM r GROUP BY 1, 2) b ON a.value = b.value GROUP BY 1, 2),
f AS (SELECT k.fold, CAST(sum(y) AS DOUBLE) / count(*) AS mean FROM (SELECT DISTINCT fold FROM r) k JOIN r ON r.fold <> k.fold GROUP BY k.fold)
SELECT r.record_index, r.value, r.fold, round_even((o.os + 10 * f.mean) / (CAST(o.oc AS DOUBLE) + 10), 6) AS encoded FROM r JOIN o ON r.value = o.value AND r.fold = o.fold JOIN f ON r.fold = f.fold""")
def oof_target_encoding(spark, sf_dir):
    return features.out_of_fold_encoding(listings(spark, sf_dir), "brand", (F.col("record_index") % 5).cast("int"), "record_index")


@query("SELECT 'brand' AS field, brand AS value, count(*) AS n FROM listings GROUP BY 2 UNION ALL SELECT 'variant', coalesce(variant, 'unknown'), count(*) FROM listings GROUP BY 2")
def frequency_encoding(spark, sf_dir):
    return features.frequencies(listings(spark, sf_dir), ["brand", "variant"])


@query("WITH c AS (SELECT coalesce(variant, 'unknown') AS value, count(*) AS n FROM listings GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS nth, count(*) OVER () AS m FROM c) SELECT value, n, m <= 250 OR nth <= 180 AS kept FROM k")
def topn_category_collapse(spark, sf_dir):
    return features.top_categories(listings(spark, sf_dir), "variant")


@query("WITH c AS (SELECT coalesce(CASE WHEN record_index % 3 = 0 THEN upper(brand) ELSE brand END, 'unknown') AS v, count(*) AS n FROM listings GROUP BY 1), k AS (SELECT *, lower(trim(v)) AS key, row_number() OVER (PARTITION BY lower(trim(v)) ORDER BY n DESC, v) AS nth, sum(n) OVER (PARTITION BY lower(trim(v))) AS t FROM c) SELECT key, v AS value, CAST(t AS BIGINT) AS n FROM k WHERE nth = 1")
def canonical_value_map(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("brand", F.when(F.col("record_index") % 3 == 0, F.upper("brand")).otherwise(F.col("brand")))
    return features.canonical_values(rows, "brand")


def _cut(c: str, edges) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} <= -1 THEN 'unknown' " + " ".join(f"WHEN {c} <= {e} THEN '{n}'" for e, n in edges) + " ELSE 'unknown' END"


_AGE = "(1999 - model_year)"


@query(f"""SELECT record_index, CAST({_AGE} AS DOUBLE) AS vehicle_age_years, {_cut(_AGE, features.AGE_BUCKETS)} AS vehicle_age_bucket, {_cut('km_driven', features.KM_BUCKETS)} AS km_bucket, round_even(km_driven / CAST(greatest({_AGE}, 1) AS DOUBLE), 4) AS km_per_year,
round_even({_AGE} * ln(1 + CAST(km_driven AS DOUBLE)), 6) AS age_km_interaction, CASE WHEN km_driven / CAST(greatest({_AGE}, 1) AS DOUBLE) <= 8000 THEN 1 ELSE 0 END AS is_low_km_for_age, CASE WHEN km_driven / CAST(greatest({_AGE}, 1) AS DOUBLE) >= 20000 THEN 1 ELSE 0 END AS is_high_km_for_age,
trim(brand) || ' ' || trim(model) AS brand_model, lower(source) || '__' || lower(city) AS source_city, lower(brand) || '__' || fuel_type AS brand_fuel_type, 'non_luxury__' || transmission AS luxury_transmission FROM listings""")
def engineered_features(spark, sf_dir):
    out = features.engineered(listings(spark, sf_dir), 1999)
    r = lambda c, n: F.bround(c, n).alias(c)
    return out.select("record_index", "vehicle_age_years", "vehicle_age_bucket", "km_bucket", r("km_per_year", 4), r("age_km_interaction", 6), "is_low_km_for_age", "is_high_km_for_age", "brand_model", "source_city", "brand_fuel_type", "luxury_transmission")


def _bands(op: str) -> str:
    return "CASE " + " ".join(f"WHEN p {op} {e} THEN '{n}'" for e, n in features.PRICE_BANDS) + " ELSE '20L_plus' END"


@query(f"SELECT record_index, CASE WHEN p < 50000 THEN 'below_50k' WHEN p > 3000000 THEN 'above_3m' ELSE 'core' END AS price_tail, {_bands('<=')} AS study_band, {_bands('<')} AS served_band FROM (SELECT record_index, listed_price_inr * 25 AS p FROM listings)")
def price_tail_and_bands(spark, sf_dir):
    p = F.col("listed_price_inr") * 25
    return listings(spark, sf_dir).select("record_index", features.price_tail(p).alias("price_tail"), features.price_band(p, True).alias("study_band"), features.price_band(p).alias("served_band"))


# --- parsers ------------------------------------------------------------------------------------------


@query("""SELECT record_index, CASE record_index % 3 WHEN 0 THEN nullif(CAST(round_even(CAST(listed_price_inr // 1000 AS DOUBLE) * 100000, 0) AS BIGINT), 0) WHEN 1 THEN nullif(listed_price_inr, 0) END AS price, CASE record_index % 3 WHEN 0 THEN CASE WHEN listed_price_inr // 1000 = 0 THEN 'invalid_price' WHEN listed_price_inr // 1000 > 500 THEN 'price_above_soft_maximum' ELSE '' END WHEN 1 THEN concat_ws(',', 'price_text_contains_emi', CASE WHEN listed_price_inr < 50000 THEN 'price_below_soft_minimum' END) ELSE 'missing_price' END AS warnings FROM listings""")
def parse_price(spark, sf_dir):
    p = F.col("listed_price_inr")
    thousands = ((p - p % 1000) / 1000).cast("bigint").cast("string")
    text = F.when(F.col("record_index") % 3 == 0, F.concat(F.lit("₹ "), thousands, F.lit(" Lakh"))).when(F.col("record_index") % 3 == 1, F.concat(F.lit("EMI Rs. "), F.format_number(p, 0), F.lit(" only"))).otherwise("Call for Price")
    out = listings(spark, sf_dir).select("record_index", P.parse_price(text).alias("r"))
    return out.select("record_index", F.col("r.value").alias("price"), F.array_join("r.warnings", ",").alias("warnings"))


@query("SELECT record_index, CASE WHEN record_index % 2 = 0 THEN km_driven ELSE CAST(km_driven // 1000 * 1000 AS BIGINT) END AS km, CASE WHEN record_index % 2 = 0 THEN 0.96 ELSE 0.96 END AS confidence FROM listings")
def parse_km(spark, sf_dir):
    km = F.col("km_driven")
    text = F.when(F.col("record_index") % 2 == 0, F.concat(F.format_number(km, 0), F.lit(" km driven"))).otherwise(F.concat(((km - km % 1000) / 1000).cast("bigint").cast("string"), F.lit("K kms")))
    return listings(spark, sf_dir).select("record_index", P.parse_km(text).alias("r")).select("record_index", F.col("r.value").alias("km"), F.col("r.confidence").alias("confidence"))


@query("SELECT record_index, CASE WHEN ownership IS NULL OR ownership = 6 THEN NULL ELSE ownership END AS owners, CASE WHEN ownership IS NULL THEN 'owner_text_is_seller_type_not_owner_count' WHEN ownership = 6 THEN 'ambiguous_ownership_text' END AS failure FROM listings")
def parse_ownership(spark, sf_dir):
    words = F.create_map(*[F.lit(x) for k, v in {1: "First Owner", 2: "2nd owner", 3: "third", 4: "4 owners", 5: "Fifth Owner"}.items() for x in (k, v)])
    text = F.when(F.col("ownership").isNull(), "Direct Owner").otherwise(F.coalesce(words[F.col("ownership")], F.lit("many owners")))
    return listings(spark, sf_dir).select("record_index", P.parse_ownership(text).alias("r")).select("record_index", F.col("r.value").alias("owners"), F.col("r.failure").alias("failure"))


@query("SELECT record_index, CASE record_index % 4 WHEN 0 THEN 'petrol_cng' WHEN 1 THEN fuel_type WHEN 2 THEN 'hybrid' ELSE NULL END AS fuel, CASE record_index % 4 WHEN 0 THEN 0.96 WHEN 1 THEN CASE WHEN fuel_type = 'unknown' THEN 0.2 ELSE 0.96 END WHEN 2 THEN 0.78 ELSE 0.0 END AS confidence FROM listings")
def parse_fuel(spark, sf_dir):
    k = F.col("record_index") % 4
    text = F.when(k == 0, "Petrol + CNG").when(k == 1, F.initcap("fuel_type")).when(k == 2, "petrol hybrid").otherwise("N/A")
    return listings(spark, sf_dir).select("record_index", P.parse_fuel(text).alias("r")).select("record_index", F.col("r.value").alias("fuel"), F.col("r.confidence").alias("confidence"))


@query("SELECT record_index, CASE record_index % 3 WHEN 0 THEN transmission WHEN 1 THEN 'amt' ELSE 'unknown' END AS box, CASE record_index % 3 WHEN 0 THEN '' WHEN 1 THEN 'multiple_transmission_candidates' ELSE 'unknown_transmission' END AS warnings FROM listings")
def parse_transmission(spark, sf_dir):
    k = F.col("record_index") % 3
    text = F.when(k == 0, F.upper("transmission")).when(k == 1, "Automated Manual").otherwise("gearless")
    return listings(spark, sf_dir).select("record_index", P.parse_transmission(text).alias("r")).select("record_index", F.col("r.value").alias("box"), F.array_join("r.warnings", ",").alias("warnings"))


@query("SELECT record_index, CASE record_index % 5 WHEN 0 THEN 'KA' || lpad(CAST(record_index % 7 + 1 AS VARCHAR), 2, '0') WHEN 1 THEN 'OD05' WHEN 2 THEN 'BH' END AS code, CASE record_index % 5 WHEN 0 THEN 'Karnataka' WHEN 1 THEN 'Odisha' WHEN 3 THEN 'Goa' END AS state, CASE record_index % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.92 WHEN 2 THEN 0.9 WHEN 3 THEN 0.7 ELSE 0.2 END AS confidence FROM listings")
def parse_registration(spark, sf_dir):
    i = F.col("record_index")
    text = F.when(i % 5 == 0, F.concat(F.lit("ka-"), (i % 7 + 1).cast("string"))).when(i % 5 == 1, "OR 5 XX").when(i % 5 == 2, "21 BH 1234").when(i % 5 == 3, "goa").otherwise("zz99")
    out = listings(spark, sf_dir).select("record_index", P.parse_registration(text).alias("r"))
    return out.select("record_index", F.col("r.value.registration_code").alias("code"), F.col("r.value.registration_state").alias("state"), F.col("r.confidence").alias("confidence"))


@query("SELECT record_index, model_year, CASE record_index % 3 WHEN 0 THEN 'Maruti Suzuki' WHEN 1 THEN 'Mahindra' END AS brand, CASE record_index % 3 WHEN 0 THEN 'Wagon R' WHEN 1 THEN 'XUV500' ELSE 'Rocket' END AS model, CASE record_index % 3 WHEN 0 THEN 'VXI 1.2' WHEN 1 THEN 'W8' END AS variant, CASE record_index % 3 WHEN 2 THEN 0.7 ELSE 0.9 END AS confidence FROM listings")
def parse_title(spark, sf_dir):
    i = F.col("record_index")
    text = F.concat(F.col("model_year").cast("string"), F.when(i % 3 == 0, " Maruti Suzuki  Wagon-R VXI 1 2").when(i % 3 == 1, " mahindra XUV 500 W8").otherwise(" Rocket"))
    out = listings(spark, sf_dir).select("record_index", P.parse_title(text, 2026).alias("r"))
    return out.select("record_index", "r.value.*", F.col("r.confidence").alias("confidence"))


@query(r"SELECT doc_id, CAST(nullif(regexp_extract(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '\b((?:19|20)[0-9]{2})\b', 1), '') AS INTEGER) AS year FROM documents", on_listings=False)
def parse_year(spark, sf_dir):
    """Over ASCII, where both engines agree on what ends a word: every other character stands as x on both sides."""
    return table(spark, sf_dir, "documents").select("doc_id", P.parse_year(F.regexp_replace("text", r"[^\x00-\x7F]", "x")).alias("year"))


# --- details ------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT 'u' || user_id AS url, min(event_id) AS position FROM events GROUP BY 1), c AS (SELECT DISTINCT 'u' || user_id AS url FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0), r AS (SELECT l.url, l.position, c.url IS NOT NULL AS hit, row_number() OVER (PARTITION BY c.url IS NOT NULL ORDER BY l.position) AS nth FROM l LEFT JOIN c ON l.url = c.url)
SELECT url, position, CASE WHEN hit THEN 'cached' WHEN nth <= 10 THEN 'selected' ELSE 'pending' END AS state FROM r""", on_listings=False)
def incremental_detail_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("position"), "event_type")
    return lifecycle.detail_plan(e, e.filter((F.col("event_type") == "purchase") & (F.col("position") % 2 == 0)), 10)


@query("""WITH r AS (SELECT 'u' || user_id AS url, event_type, event_id AS position, value, event_id % 3 = 0 AS ok, event_id % 2 = 0 AS has_raw FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ok DESC, has_raw DESC, position) AS nth FROM r) SELECT url, position, ok, has_raw, value FROM k WHERE nth = 1""", on_listings=False)
def preferred_record_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("position"), (F.col("event_id") % 3 == 0).alias("ok"), (F.col("event_id") % 2 == 0).alias("has_raw"), "value")
    return lifecycle.preferred_records(e).select("url", "position", "ok", "has_raw", "value")


@query("""WITH l AS (SELECT DISTINCT user_id AS url FROM events), n AS (SELECT user_id AS url, max(event_id) AS d FROM events WHERE event_id % 50 = 0 GROUP BY 1), o AS (SELECT user_id AS url, min(event_id) AS d FROM events WHERE event_id % 20 = 1 GROUP BY 1)
SELECT l.url, coalesce(n.d, o.d) AS detail, CASE WHEN n.url IS NOT NULL THEN 'new_capture' WHEN o.url IS NOT NULL THEN 'cache' ELSE 'missing' END AS detail_record_source FROM l LEFT JOIN n ON l.url = n.url LEFT JOIN o ON l.url = o.url""", on_listings=False)
def detail_merge_priority(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), "event_id")
    fresh = e.filter(F.col("event_id") % 50 == 0).groupBy("url").agg(F.max("event_id").alias("detail"))
    cache = e.filter(F.col("event_id") % 20 == 1).groupBy("url").agg(F.min("event_id").alias("detail"))
    return lifecycle.merge_details(e.select("url").distinct(), fresh, cache, ["detail"])


# --- adapters, models and pages -----------------------------------------------------------------------

_RUN = adapters.Run("1997-06-01T00:00:00Z", "run_1", "Pune", "Maharashtra")


def cards(spark, sf_dir):
    """Order lines written out as one source's raw listing cards."""
    i, p = F.col("record_index"), F.col("listed_price_inr")
    given = {
        "title": F.concat(F.col("model_year").cast("string"), F.when(i % 2 == 0, " Honda City VX").otherwise(" Tata Nexon XM")), "price": F.concat(F.lit("Rs "), p.cast("string")), "variant": F.when(i % 3 != 0, "VX CVT"), "km": F.concat(F.col("km_driven").cast("string"), F.lit(" km")),
        "fuel": F.col("fuel_type"), "transmission": F.col("transmission"), "registration": F.lit("MH 12"), "locality": F.lit("Baner, Pune"), "listing_url": F.col("listing_url"),
    }
    raw = F.struct(*[given.get(n, F.lit(None).cast("string")).alias(n) for n in adapters.raw_fields("spinny")])
    return listings(spark, sf_dir).select(i.alias("index"), F.lit("https://cars.example").alias("source_url"), raw.alias("raw"))


@query("""SELECT record_index AS index, CASE record_index % 2 WHEN 0 THEN 'Honda' ELSE 'Tata' END AS brand, CASE record_index % 2 WHEN 0 THEN 'City' ELSE 'Nexon' END AS model, CASE WHEN record_index % 3 <> 0 THEN 'VX CVT' WHEN record_index % 2 = 0 THEN 'VX' ELSE 'XM' END AS variant, model_year, listed_price_inr, km_driven, fuel_type, transmission, 'MH12' AS registration_code,
CASE fuel_type WHEN 'unknown' THEN 0.2 ELSE 0.9 END AS parse_confidence, concat_ws(',', 'variant_inferred', CASE WHEN listed_price_inr < 50000 THEN 'price_below_soft_minimum' END, CASE fuel_type WHEN 'unknown' THEN 'unknown_fuel_type' END, CASE WHEN record_index % 3 = 0 THEN 'variant_recovered_from_title' END) AS parse_warnings FROM listings""")
def canonical_projection(spark, sf_dir):
    out = adapters.canonical(cards(spark, sf_dir), "spinny", _RUN, 2026)
    return out.select("index", "brand", "model", "variant", "model_year", "listed_price_inr", "km_driven", "fuel_type", "transmission", "registration_code", "parse_confidence", F.array_join("parse_warnings", ",").alias("parse_warnings"))


@query("SELECT record_index AS record_index, 'variant' AS field_name, 'missing_required_raw_field' AS reason FROM listings WHERE record_index % 3 = 0 UNION ALL SELECT record_index, 'fuel', 'missing_required_raw_field' FROM listings WHERE FALSE")
def payload_contract(spark, sf_dir):
    return adapters.contract(cards(spark, sf_dir), "spinny")


@query()
def gbt_price_predictions(spark, sf_dir):
    """Boosted trees of the operator's own size, trained on the split's larger side, predicting the smaller one; rows only."""
    train, test = halves(spark, sf_dir)
    model = pricing_model.fit(train, snapshot_year=1999)
    return model.predict(test, once=True).select("record_key", "listed_price_inr", F.bround("predicted_price_inr", 2).alias("predicted_price_inr"))


@query("WITH r AS (SELECT record_key, source, listed_price_inr FROM listings) SELECT record_key, CASE WHEN listed_price_inr < 50000 THEN 'below' ELSE 'above' END AS edge FROM r WHERE listed_price_inr < 50000 OR listed_price_inr > 3000000")
def edge_price_rows(spark, sf_dir):
    return profiling.edge_prices(listings(spark, sf_dir)).select("record_key", F.when(F.col("listed_price_inr") < 50_000, "below").otherwise("above").alias("edge"))


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER ({f} IS NULL OR trim(CAST({f} AS VARCHAR)) = '') AS missing FROM listings HAVING count(*) FILTER ({f} IS NULL OR trim(CAST({f} AS VARCHAR)) = '') > 0" for f in _FIELDS))
def missing_report(spark, sf_dir):
    return profiling.completeness(listings(spark, sf_dir), _FIELDS).filter("missing > 0").select("field", "missing")


@query("SELECT record_key, concat_ws(',', CASE WHEN variant IS NULL THEN NULL END, CASE WHEN model_year NOT BETWEEN 2000 AND 2026 THEN 'model_year_out_of_range' END, CASE WHEN km_driven NOT BETWEEN 0 AND 300000 THEN 'km_out_of_range' END, CASE WHEN ownership NOT BETWEEN 1 AND 5 THEN 'ownership_out_of_range' END) AS violations FROM listings")
def request_violations(spark, sf_dir):
    return listings(spark, sf_dir).select("record_key", F.array_join(features.request_violations(), ",").alias("violations"))


# --- captures -----------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT 'u' || user_id AS url, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN event_id % 8 = 0 THEN 'timeout' WHEN event_id % 4 = 0 THEN 'detail_fields_missing' END AS failure, CAST(event_id % 3 + 1 AS INTEGER) AS attempts FROM events)
SELECT count(*) AS attempted, count(DISTINCT url) AS unique_urls, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed, count(*) FILTER (failure = 'timeout') AS timeouts, CAST(sum(attempts - 1) AS BIGINT) AS retries, round_even(count(*) FILTER (status = 'ok') / CAST(count(*) AS DOUBLE), 4) AS coverage FROM d""", on_listings=False)
def capture_summary(spark, sf_dir):
    k = F.col("event_id")
    d = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.when(k % 4 == 0, "failed").otherwise("ok").alias("status"), F.when(k % 8 == 0, "timeout").when(k % 4 == 0, "detail_fields_missing").alias("failure"), (k % 3 + 1).cast("int").alias("attempts"))
    return captures.detail_summary(d)


@query("SELECT doc_id, CASE WHEN n >= 30 THEN 'record_cap_reached' WHEN p >= 5 AND n >= 10 THEN 'min_records_reached_at_page_cap' WHEN p >= t THEN 'total_pages_reached' WHEN p >= 5 THEN 'page_cap_reached' ELSE 'unknown' END AS reason FROM (SELECT doc_id, doc_id % 40 AS n, doc_id % 7 AS p, doc_id % 9 AS t FROM documents)", on_listings=False)
def stop_reasons(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", captures.stop_reason(d % 40, F.lit(30), F.lit(10), d % 7, d % 9, F.lit(5)).alias("reason"))


@query("WITH j AS (SELECT c_mktsegment AS source, count(*) AS jobs FROM customer GROUP BY 1) SELECT source, jobs, CASE WHEN source IN ('AUTOMOBILE', 'BUILDING') THEN 'skipped' ELSE 'planned' END AS state FROM j", on_listings=False)
def resume_plan(spark, sf_dir):
    jobs = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("source")).agg(F.count("*").alias("jobs"))
    passed = spark.createDataFrame([("AUTOMOBILE",), ("BUILDING",), ("BUILDING",)], "source string")
    return ledger.resume(jobs, passed, ["source"])

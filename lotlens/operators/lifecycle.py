"""Identity of listings and vehicles, sightings over time, and what changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scalars import bind, bucket, int_truncated, normal_url, short_hash, token

OBSERVATION_FIELDS = (
    "listing_key", "source", "source_listing_id", "listing_url", "run_id", "capture_date", "captured_at", "city", "state", "brand", "model", "variant",
    "model_year", "fuel_type", "transmission", "km_driven", "ownership", "registration_code", "listed_price_inr", "is_available",
)


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) if name in df.columns else F.lit("")


def _year(df: DataFrame) -> Column:
    return F.coalesce(*[F.nullif(F.nullif(_text(df, n), F.lit("")), F.lit("0")) for n in ("model_year", "manufacture_year")], F.lit(""))


def with_identity(df: DataFrame) -> DataFrame:
    """listing_identity_basis, _value and listing_key: URL, else id, else raw hash, else seven core fields."""
    url, own, raw = normal_url(_text(df, "listing_url")), _text(df, "source_listing_id"), _text(df, "raw_record_hash")
    core = F.concat_ws("|", *[token(c) for c in (_text(df, "city"), _text(df, "brand"), _text(df, "model"), _text(df, "variant"), _year(df), _text(df, "listed_price_inr"), _text(df, "km_driven"))])
    rung = lambda basis, value: F.struct(F.lit(basis).alias("basis"), value.alias("value"))
    below = F.when(own != "", rung("source_listing_id", token(own))).when(raw != "", rung("raw_record_hash", token(raw))).otherwise(rung("core_fields", core))
    basis = bind(url, lambda u: F.when(u != "", rung("listing_url", u)).otherwise(below))
    # basis, value and key are one struct, so that nothing is evaluated once for each of them
    material = lambda r: F.concat_ws("|", token(_text(df, "source")), r["basis"], r["value"])
    identity = bind(basis, lambda r: F.struct(r["basis"].alias("basis"), r["value"].alias("value"), F.concat(F.lit("listing_"), short_hash(material(r))).alias("key")))
    names = {"listing_identity_basis": "basis", "listing_identity_value": "value", "listing_key": "key"}
    out = df.withColumn("listing_identity", identity)
    return out.withColumns({name: F.col(f"listing_identity.{part}") for name, part in names.items()}).drop("listing_identity")


def with_fingerprint(df: DataFrame) -> DataFrame:
    """vehicle_fingerprint of eleven components in the order of their names; empty if one is missing."""
    step = lambda n, size: F.coalesce(bucket(F.col(n), size).cast("string"), F.lit("")) if n in df.columns else F.lit("")
    parts = {n: token(_text(df, n)) for n in ("brand", "city", "fuel_type", "model", "ownership", "registration_code", "transmission", "variant")}
    parts |= {"km_bucket": step("km_driven", V.KM_BUCKET), "price_bucket": step("listed_price_inr", V.PRICE_BUCKET), "year": token(_year(df))}
    printed = lambda p: F.when(F.array_contains(p, ""), F.lit("")).otherwise(F.concat(F.lit("vehicle_"), short_hash(F.array_join(p, "|"))))
    return df.withColumn("vehicle_fingerprint", bind(F.array(*[parts[n] for n in sorted(parts)]), printed))


def _order() -> Column:
    return F.struct(F.coalesce("captured_at", F.lit("")), F.coalesce("run_id", F.lit("")), F.coalesce("record_index", F.lit(0)))


def entities(observations: DataFrame, latest: tuple[str, ...]) -> DataFrame:
    """One row per listing_key: counts, first and last sighting, dates and runs, the latest row's fields.

    One aggregation: the latest row travels as a struct under max_by, so nothing is sorted or joined.
    """
    filled = lambda c: F.sort_array(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    grouped = observations.groupBy("listing_key").agg(
        F.count("*").alias("observation_count"), F.min_by("captured_at", _order()).alias("first_seen_at"), F.max_by("captured_at", _order()).alias("last_seen_at"),
        filled("capture_date").alias("capture_dates"), filled("run_id").alias("run_ids"), F.max_by(F.struct(*latest), _order()).alias("latest"),
    )
    return grouped.select("*", *[F.col(f"latest.{f}").alias(f) for f in latest]).drop("latest")


def latest_rows(observations: DataFrame) -> DataFrame:
    """The whole latest row of each listing."""
    w = W.partitionBy("listing_key").orderBy(F.desc("captured_at"), F.desc("run_id"), F.desc("record_index"))
    return observations.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def duplicate_vehicles(observations: DataFrame) -> DataFrame:
    """Fingerprints that more than one listing carries."""
    return _duplicates(_per_vehicle(observations))


def _per_vehicle(observations: DataFrame) -> DataFrame:
    return observations.groupBy("vehicle_fingerprint", "listing_key", "source", "city").agg(F.count("*").alias("n"))


def _duplicates(per: DataFrame) -> DataFrame:
    named = per.filter(F.coalesce(F.col("vehicle_fingerprint"), F.lit("")) != "")
    names = lambda c: F.sort_array(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    groups = named.groupBy("vehicle_fingerprint").agg(F.sum("n").alias("observation_count"), F.sort_array(F.collect_set("listing_key")).alias("listing_keys"), names("source").alias("sources"), names("city").alias("cities"))
    return groups.withColumn("listing_key_count", F.size("listing_keys").cast("bigint")).filter("listing_key_count > 1")


def totals_by_source(observations: DataFrame) -> DataFrame:
    """Rows, listings, listings seen again and duplicate groups of each source.

    Both halves stand on one count by fingerprint, key, source and city, whose exchange is shared.
    """
    per = _per_vehicle(observations)
    per_key = per.groupBy("source", "listing_key").agg(F.sum("n").alias("n"))
    rows = per_key.groupBy("source").agg(F.sum("n").alias("records"), F.count("*").alias("unique_listing_keys"), F.count_if(F.col("n") > 1).alias("reobserved_listing_groups"))
    groups = _duplicates(per).select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("possible_vehicle_duplicate_groups"))
    return rows.join(groups, "source", "left").fillna(0, ["possible_vehicle_duplicate_groups"])


def totals(observations: DataFrame) -> DataFrame:
    """One row of the whole table's counts."""
    per = _per_vehicle(observations)
    per_key = per.groupBy("listing_key").agg(F.sum("n").alias("n")).select("n", F.lit(0).alias("dup"))
    groups = _duplicates(per).select(F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("dup"))
    key = F.col("dup") == 0
    return per_key.unionByName(groups).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records_total"), F.count_if(key).alias("unique_listing_keys"), F.count_if(key & (F.col("n") > 1)).alias("reobserved_listing_groups"), F.count_if(~key).alias("possible_vehicle_duplicate_groups")
    )


def identity_comparison(observations: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Distinct counts of the same rows under several identity rules."""
    one = observations.agg(F.count("*").alias("observations"), *[F.count_distinct(c).alias(n) for n, c in rules.items()])
    return one.select("observations", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("identities")) for n in rules])).alias("r")).select("observations", "r.*")


# --- two snapshots ------------------------------------------------------------------------------------


def last_by_key(entities_: DataFrame, position: str) -> DataFrame:
    """The last row of each filled listing_key."""
    named = entities_.filter(F.coalesce(F.col("listing_key"), F.lit("")) != "")
    w = W.partitionBy("listing_key").orderBy(F.desc(position))
    return named.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def snapshot_diff(current: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Full outer join on listing_key: status, both sides' source, price and km, and their changes.

    Both sides: listing_key (unique), source, listed_price_inr, km_driven. Without a previous snapshot
    everything is added.
    """
    pick = lambda df, p: df.select("listing_key", F.col("source").alias(f"{p}_source"), int_truncated(F.col("listed_price_inr")).alias(f"{p}_price_inr"), int_truncated(F.col("km_driven")).alias(f"{p}_km"), F.lit(True).alias(f"in_{p}"))
    before = pick(current.limit(0) if previous is None else previous, "previous")
    return _compared(pick(current, "current").join(before, "listing_key", "full_outer"))


def diff_of_observations(rows: DataFrame, is_current: Column, position: str) -> DataFrame:
    """:func:`snapshot_diff` of the last rows (by ``position``) of each side, from one pass over both.

    ``is_current`` tells the sides apart. The last row of each side travels under ``max_by`` in one
    aggregation by key; rows without a key take no part.
    """
    one = F.struct(F.col("source").alias("source"), int_truncated(F.col("listed_price_inr")).alias("price"), int_truncated(F.col("km_driven")).alias("km"))
    last = lambda side: F.max_by(one, F.when(side, F.col(position)))
    # the key is tested behind the aggregation, where the test can't be pushed down and compute it again
    sides = rows.groupBy("listing_key").agg(last(is_current).alias("c"), last(~is_current).alias("p"), F.count_if(is_current).alias("nc"), F.count_if(~is_current).alias("np"), F.max("listing_key").alias("named"))
    flat = [F.col(f"{s}.{f}").alias(f"{name}_{as_}") for s, name in (("c", "current"), ("p", "previous")) for f, as_ in (("source", "source"), ("price", "price_inr"), ("km", "km"))]
    marks = [F.when(F.col("nc") > 0, True).alias("in_current"), F.when(F.col("np") > 0, True).alias("in_previous")]
    return _compared(sides.filter(F.coalesce(F.col("named"), F.lit("")) != "").select("listing_key", *flat, *marks))


def _compared(both: DataFrame) -> DataFrame:
    status = F.when(F.col("in_previous").isNull(), "added").when(F.col("in_current").isNull(), "removed").otherwise("still_active")
    delta = lambda a, b: F.when((status == "still_active") & (F.col(a) != F.col(b)), F.col(a) - F.col(b))
    change = delta("current_price_inr", "previous_price_inr")
    pct = F.when(F.col("previous_price_inr") != 0, F.bround(change / F.col("previous_price_inr") * 100, 2))
    return both.select(
        "listing_key", status.alias("status"), F.coalesce("current_source", "previous_source").alias("source"), "previous_source", "current_source", "previous_price_inr", "current_price_inr",
        change.alias("price_delta_inr"), pct.alias("price_delta_pct"), "previous_km", "current_km", delta("current_km", "previous_km").alias("km_delta"),
    )


def diff_totals_by_source(diff: DataFrame) -> DataFrame:
    """Seven counters a source; a removed or previous listing counts for its previous source."""
    one = lambda c, name: F.when(c, F.lit(name))
    is_ = lambda s: F.col("status") == s
    current = F.array_compact(F.array(one(~is_("removed"), "current"), one(is_("added"), "added"), one(is_("still_active"), "still_active"), one(F.col("price_delta_inr").isNotNull(), "price_changes"), one(F.col("km_delta").isNotNull(), "km_changes")))
    previous = F.array_compact(F.array(one(~is_("added"), "previous"), one(is_("removed"), "removed")))
    marks = diff.select(F.explode(F.concat(F.transform(current, lambda m: F.struct(F.col("current_source").alias("source"), m.alias("mark"))), F.transform(previous, lambda m: F.struct(F.col("previous_source").alias("source"), m.alias("mark"))))).alias("m")).select("m.*")
    names = ("previous", "current", "added", "removed", "still_active", "price_changes", "km_changes")
    return marks.groupBy("source").agg(*[F.count_if(F.col("mark") == n).alias(n) for n in names])


def diff_totals(diff: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    changed = F.col("price_delta_inr").isNotNull() | F.col("km_delta").isNotNull()
    return diff.agg(
        F.count_if(F.col("status") != "added").alias("previous_unique_listing_keys"), F.count_if(F.col("status") != "removed").alias("current_unique_listing_keys"), is_("added").alias("added_count"), is_("removed").alias("removed_count"),
        is_("still_active").alias("still_active_count"), F.count("price_delta_inr").alias("price_change_count"), F.count("km_delta").alias("km_change_count"), F.count_if(changed).alias("changed_listing_count"),
    )


def largest_changes(diff: DataFrame, column: str, top: int = 20) -> DataFrame:
    return diff.filter(F.col(column).isNotNull()).orderBy(F.desc(F.abs(column)), "listing_key").limit(top)


# --- details and their cache --------------------------------------------------------------------------


def preferred_records(records: DataFrame) -> DataFrame:
    """Of the detail rows of a URL: captured before failed, with content before without, else the first."""
    w = W.partitionBy("url").orderBy(F.desc(F.coalesce(F.col("ok"), F.lit(False))), F.desc(F.coalesce(F.col("has_raw"), F.lit(False))), "position")
    return records.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def distinct_in_order(rows: DataFrame, key: str, position: str) -> DataFrame:
    return rows.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min(position).alias(position))


def detail_plan(listings: DataFrame, cache: DataFrame, most_new: int) -> DataFrame:
    """Every listed URL in order with ``state``: cached, selected (the first ``most_new`` others) or pending."""
    urls = distinct_in_order(listings, "url", "position")
    marked = urls.join(cache.select("url", F.lit(True).alias("hit")).distinct(), "url", "left")
    missing = urls.join(cache, "url", "left_anti").orderBy("position").limit(max(0, most_new)).select("url", F.lit(True).alias("chosen"))
    state = F.when(F.col("hit"), "cached").when(F.col("chosen"), "selected").otherwise("pending")
    return marked.join(missing, "url", "left").select("url", "position", state.alias("state"))


def merge_details(listings: DataFrame, fresh: DataFrame, cache: DataFrame, fields: list[str]) -> DataFrame:
    """Listings with ``fields`` from a new capture, else the cache, else their own; and where from."""
    side = lambda df, p: df.select("url", *[F.col(f).alias(f"{p}_{f}") for f in fields], F.lit(True).alias(f"in_{p}"))
    out = listings.join(side(fresh, "new"), "url", "left").join(side(cache, "old"), "url", "left")
    origin = F.when(F.col("in_new"), "new_capture").when(F.col("in_old"), "cache").otherwise("missing")
    first = lambda f: F.coalesce(*([F.col(f)] if f in listings.columns else []), F.when(F.col("in_new"), F.col(f"new_{f}")).otherwise(F.col(f"old_{f}"))).alias(f)
    return out.select("url", *[c for c in listings.columns if c != "url" and c not in fields], *map(first, fields), origin.alias("detail_record_source"))

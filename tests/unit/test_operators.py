"""Quality gates, lifecycle, diffs, ledgers, adapters, models and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from lotlens.operators import adapters, baseline, external, features, ledger, lifecycle, pricing_model, quality
from lotlens.sources import payloads, sinks

GOOD = {
    "source": "spinny", "listing_url": "https://a/1", "captured_at": "2026-06-24T10:00:00Z", "city": "Hyderabad", "brand": "Honda", "model": "Jazz", "variant": "V AT", "model_year": 2016, "listed_price_inr": 403000, "km_driven": 145500,
    "fuel_type": "petrol", "transmission": "automatic", "currency": "INR", "raw_record_hash": "h", "ingestion_run_id": "r", "parser_version": "p", "schema_version": "s", "parse_confidence": 0.95, "parse_warnings": [], "is_available": True,
    "source_record_type": "listing", "source_listing_id": None, "commercial_vehicle_flag": None,
}
SCHEMA = ", ".join(f"{k} {'int' if k == 'model_year' else 'bigint' if k in ('listed_price_inr', 'km_driven') else 'double' if k == 'parse_confidence' else 'boolean' if k in ('is_available', 'commercial_vehicle_flag') else 'array<string>' if k == 'parse_warnings' else 'string'}" for k in GOOD)
CASES = [
    ({}, True, True, []), ({"source": "olx"}, True, False, ["source_not_mvp_eligible"]), ({"fuel_type": None, "transmission": None}, True, False, ["missing_fuel_type", "missing_transmission"]), ({"fuel_type": "unknown"}, True, False, ["missing_fuel_type", "unknown_fuel_type"]),
    ({"is_available": False}, True, False, ["listing_unavailable"]), ({"source_record_type": "ad"}, False, False, ["non_listing_record"]), ({"model": "Wagon R 1.0"}, True, False, ["model_contains_engine_or_displacement"]), ({"variant": "Rs 7.27 Lakh"}, True, False, ["variant_contains_price_text"]),
    ({"parse_confidence": 0.72}, True, False, ["parse_confidence_below_gold_threshold"]), ({"listed_price_inr": 0}, False, False, ["invalid_price"]), ({"captured_at": "yesterday"}, False, False, ["invalid_captured_at"]), ({"parse_warnings": ["unknown_fuel_type", "odd"]}, True, False, ["unknown_fuel_type"]),
    ({"source": "nobody"}, True, False, ["unknown_source"]), ({"commercial_vehicle_flag": True}, True, False, ["commercial_vehicle"]), ({"model_year": 2029}, False, False, ["invalid_model_year"]),
]


def test_quality(spark):
    rows = spark.createDataFrame([tuple((GOOD | c[0]).values()) for c in CASES], SCHEMA).withColumn("n", F.monotonically_increasing_id())
    registry = spark.createDataFrame([("spinny", "primary", 1, "platform"), ("olx", "research_only", 99, "classified")], "source string, role string, priority int, kind string")
    got = quality.evaluate(rows, 2026, registry).orderBy("n").collect()
    assert [(r.silver_valid, r.pricing_ready, r.reasons) for r in got] == [c[1:] for c in CASES]
    assert got[1].warnings == ["classified_source"] and got[11].warnings == ["odd"] and got[0].required == 1.0
    summary = quality.run_status(quality.run_summary(quality.evaluate(rows.limit(1), 2026))).first()
    assert (summary.total, summary.pricing_ready, summary.status, summary.run_ready) == (1, 1, "PASS", True)


def test_lifecycle(spark):
    schema = "listing_key string, source string, run_id string, capture_date string, captured_at string, record_index bigint, vehicle_fingerprint string, city string, listed_price_inr bigint"
    rows = spark.createDataFrame([("a", "s", "r1", "d1", "t1", 1, "v", "c", 5), ("a", "s", "r2", "d2", "t2", 1, "v", "c", 6), ("b", "s", "r2", "d2", "t2", 2, "v", "c", 7)], schema)
    by = {r.listing_key: r for r in lifecycle.entities(rows, ("source", "listed_price_inr")).collect()}
    assert by["a"].observation_count == 2 and by["a"].first_seen_at == "t1" and by["a"].listed_price_inr == 6 and by["a"].run_ids == ["r1", "r2"]
    assert lifecycle.totals(rows).first().asDict() == {"records_total": 3, "unique_listing_keys": 2, "reobserved_listing_groups": 1, "possible_vehicle_duplicate_groups": 1}
    assert sum(r.observation_count for r in by.values()) == rows.count()


def test_fingerprint_pair(spark):
    schema = "source string, city string, brand string, model string, variant string, model_year int, fuel_type string, transmission string, ownership int, registration_code string, km_driven bigint, listed_price_inr bigint"
    car = ("s", "Delhi NCR", "Maruti Suzuki", "Wagon R", "LXI", 2011, "petrol", "manual", 1, "DL13")
    rows = spark.createDataFrame([(*car, 56158, 70000), (*car, 56321, 68000), (*car[:9], None, 56321, 68000)], schema)
    prints = [r.vehicle_fingerprint for r in lifecycle.with_fingerprint(rows).collect()]
    assert prints[0] == prints[1] != "" and prints[2] == ""


def test_diff(spark):
    schema = "listing_key string, source string, listed_price_inr string, km_driven string"
    old = spark.createDataFrame([("a", "s", "500000", "10000"), ("b", "s", "1", "1")], schema)
    new = spark.createDataFrame([("a", "s", "475000", "12500.0"), ("c", "s", "1", None)], schema)
    diff = lifecycle.snapshot_diff(new, old)
    rows = {r.listing_key: r for r in diff.collect()}
    assert (rows["a"].price_delta_inr, rows["a"].price_delta_pct, rows["a"].km_delta) == (-25000, -5.0, 2500)
    t = lifecycle.diff_totals(diff).first()
    assert (t.added_count, t.removed_count, t.still_active_count) == (1, 1, 1) and t.current_unique_listing_keys == 2 == t.previous_unique_listing_keys
    assert lifecycle.diff_totals(lifecycle.snapshot_diff(new)).first().added_count == 2


def test_planning(spark):
    figures = spark.createDataFrame([(909,)], "current bigint")
    rows = {r.scenario: r for r in ledger.scale_projection(figures, 100_000).collect()}
    assert rows["recommended"].remaining == 99091 and rows["recommended"].future_snapshots == 20
    assert ledger.allocate(5001) == {"true_value": 2501, "mahindra_first_choice": 1500, "spinny": 1000}
    by = spark.createDataFrame([("true_value", 2448), ("mahindra_first_choice", 510), ("spinny", 320)], "source string, pricing_ready bigint")
    gap = {r.source: r for r in ledger.gap_strategy(by, {"true_value": 2500, "mahindra_first_choice": 1500, "spinny": 1000}, 5000).collect()}
    assert [gap[s].allocation_gap for s in ("true_value", "mahindra_first_choice", "spinny")] == [52, 990, 680]
    assert [gap[s].status for s in ("true_value", "mahindra_first_choice", "spinny")] == ["near_allocation", "capacity_constrained", "incremental_expansion_needed"]
    with pytest.raises(ValueError, match="wrong"):
        ledger.require(ledger.checks(figures, {"fine": F.lit(True), "wrong": F.col("current") < 0}))


def test_incremental_details(spark):
    listed = spark.createDataFrame([("u1", 0), ("u2", 1), ("u1", 2), ("u3", 3)], "url string, position int")
    cache = spark.createDataFrame([("u2", "cached")], "url string, ownership string")
    plan = {r.url: r.state for r in lifecycle.detail_plan(listed, cache, 1).collect()}
    assert plan == {"u1": "selected", "u2": "cached", "u3": "pending"}
    fresh = spark.createDataFrame([("u1", "new")], "url string, ownership string")
    rows = listed.select("url").distinct().withColumn("ownership", F.lit(None).cast("string"))
    merged = {r.url: (r.ownership, r.detail_record_source) for r in lifecycle.merge_details(rows, fresh, cache, ["ownership"]).collect()}
    assert merged == {"u1": ("new", "new_capture"), "u2": ("cached", "cache"), "u3": (None, "missing")}


def payload(tmp_path, source, records):
    path = tmp_path / f"{source}{len(list(tmp_path.iterdir()))}.json"
    path.write_text(json.dumps({"source": source, "source_url": "https://www.site.example/x", "records": [{"raw": r} for r in records]}))
    return str(path)


RAW = {
    "spinny": {"title": "2016 Honda Jazz", "price": "4.03 Lakh", "variant": "V AT Petrol", "emi": "EMI Rs 7,013/m*", "km": "145.5K km", "fuel": "petrol", "transmission": "automatic", "registration": "TS12", "locality": "Hub, Hyderabad"},
    "mahindra_first_choice": {"score": 8.5, "title": "2019 Mahindra XUV500", "variant_details": "W8 | 50,000 km | Diesel | Manual", "price": "9.5 Lakh", "locality": "Pune", "id_classified": "77"},
    "true_value": {"sku": "S1", "title": "2018 Maruti Swift VXI", "price": 550000, "model_year": 2018, "model": "Swift", "variant": "VXI", "km": "42,000 km", "fuel": "Petrol", "transmission": "MT", "ownership": "1", "registration": "TS07", "locality": "Hyd", "warranty_info": "1Y", "true_value_certified": "CR", "url_key": "swift-1", "in_stock": True},
}


def test_adapters(spark, tmp_path):
    run, got = adapters.Run("2026-06-24T10:00:00Z", "run", "Hyderabad", "Telangana"), {}
    for source, raw in RAW.items():
        rows = payloads.checked_payload(spark, payload(tmp_path, source, [raw]), source)
        got[source] = adapters.canonical(rows, source, run, 2026)
        judged = quality.evaluate(got[source], 2026).first()
        assert judged.pricing_ready and judged.reasons == [], (source, judged.reasons)
    s, m, t = (got[k].first() for k in RAW)
    assert (s.listed_price_inr, s.km_driven, s.registration_code, s.variant, s.emi_amount_inr, s.finance_label) == (403000, 145500, "TS12", "V AT Petrol", 7013, "finance_available")
    assert (m.source_listing_id, m.brand, m.model, m.variant, m.km_driven, m.fuel_type) == ("mfc_77", "Mahindra", "XUV500", "W8", 50000, "diesel")
    assert (t.source_listing_id, t.listing_url, t.warranty_label, t.inspection_status, t.ownership) == ("true_value_S1", "https://www.site.example/swift-1", "1 year warranty", "true_value_certified", 1)
    with pytest.raises(ValueError, match="record 1 title: missing_required_raw_field"):
        payloads.checked_payload(spark, payload(tmp_path, "spinny", [RAW["spinny"] | {"title": None}]), "spinny")
    with pytest.raises(ValueError, match="score_must_be_decimal_0_to_10"):
        payloads.checked_payload(spark, payload(tmp_path, "mahindra_first_choice", [RAW["mahindra_first_choice"] | {"score": "11"}]), "mahindra_first_choice")
    out = sinks.write_layers(quality.evaluate(got["spinny"], 2026), str(tmp_path / "out"), "2026-06-24", "run")
    assert spark.read.parquet(out["silver"]).filter("source = 'spinny'").count() == 1


def test_ladder_takes_first_eligible_level(spark):
    cols = "id int, city string, brand string, model string, model_year int, fuel_type string, transmission string, ownership int, listed_price_inr bigint"
    train = spark.createDataFrame([(i, "c", "b", "m" if i < 3 else "n", 2000, "f", "t", 1, 100 + i) for i in range(6)], cols)
    test = spark.createDataFrame([(1, "c", "b", "m", 2000, "f", "t", 1, 100), (2, "c", "b", "n", 2000, "f", "t", None, 100), (3, "x", None, "q", 1, "f", "t", 1, 0)], cols)
    got = {r.id: r for r in baseline.predict(test, baseline.group_medians(train), 3, "id").collect()}
    assert got[1].prediction_level == "city_brand_model_year_fuel_transmission_ownership" and got[1].predicted_price_inr == 101
    assert got[2].prediction_level == "brand_model_year_fuel_transmission" and got[3].prediction_level == "global" and got[3].absolute_percentage_error is None


def test_external(spark, tmp_path):
    head = list(external.COLUMNS)
    line = lambda **k: ",".join(str(k.get(c, "")) for c in head)
    good = {"id": 1, "yr_mfr": 2015, "fuel_type": "petrol", "kms_run": 8063, "sale_price": 386399, "city": "noida", "transmission": "manual", "variant": "lxi", "assured_buy": "True", "source": "inspection", "make": "maruti", "model": "Wagon-R-1-0", "total_owners": 2}
    for name, rows in (("train", [good, good | {"source": "customer_to_customer", "assured_buy": "False"}]), ("test", [good])):
        (tmp_path / f"{name}.csv").write_text("\n".join([",".join(head), *[line(**r) for r in rows]]) + "\n")
    raw = external.read_splits(spark, {"train": str(tmp_path / "train.csv"), "test": str(tmp_path / "test.csv")})
    assert external.raw_profile(raw).first().duplicate_ids == 2
    rows = external.canonical(raw).collect()
    assert {r.model for r in rows} == {"Wagon R"} and sorted(map(tuple, {tuple(r.reasons) for r in rows})) == [(), ("source_channel_customer_to_customer", "assured_buy_false")]
    assert all(r.status == "pass" for r in external.validate(external.trusted(external.canonical(raw)), "true_value_external_kaggle").collect())


def test_price_model(spark, tmp_path):
    rows = spark.range(600).select(
        F.col("id").cast("string").alias("key"), F.lit("s").alias("source"), F.lit("c").alias("city"), F.when(F.col("id") % 2 == 0, "Audi").otherwise("Tata").alias("brand"), (F.col("id") % 3).cast("string").alias("model"), F.lit("v").alias("variant"), F.lit("DL1").alias("registration_code"),
        (2010 + F.col("id") % 10).cast("int").alias("model_year"), F.lit("petrol").alias("fuel_type"), F.lit("manual").alias("transmission"), (F.col("id") * 100).alias("km_driven"), (200000 + (F.col("id") % 2 == 0).cast("int") * 800000 + (F.col("id") % 10) * 10000).cast("bigint").alias("listed_price_inr"),
    )
    split = pricing_model.stratified_split(rows, "key")
    assert 0.1 < split.filter("is_test").count() / 600 < 0.3
    model = pricing_model.fit(split.filter("NOT is_test"), iterations=8, depth=4, snapshot_year=2026)
    out = model.predict(split.filter("is_test")).selectExpr("avg(abs(predicted_price_inr - listed_price_inr) / listed_price_inr) AS ape", "min(predicted_price_inr) AS low").first()
    assert out.ape < 0.25 and out.low > 0
    model.save(str(tmp_path / "model"))
    again = pricing_model.PriceModel.load(spark, str(tmp_path / "model"))
    assert abs(again.predict(rows.limit(1)).first().predicted_price_inr - model.predict(rows.limit(1)).first().predicted_price_inr) < 1e-6


def test_price_model_merges_equal_rows(spark, monkeypatch):
    """boosting passes over equal rows once, with the trees of all rows."""
    i, h = F.col("id"), F.pmod(F.xxhash64("id"), F.lit(1000))
    once = spark.range(240).select(
        *[F.concat(F.lit(n), (F.pmod(F.xxhash64(F.lit(n), "id"), F.lit(m))).cast("string")).alias(n) for n, m in (("source", 3), ("city", 5), ("brand", 4), ("model", 6), ("variant", 9), ("registration_code", 4), ("fuel_type", 2), ("transmission", 2))],
        (2008 + h % 9).cast("int").alias("model_year"), F.when(i % 11 != 0, i * 731 % 1009 * 100).alias("km_driven"), (100_000 + h * 1777 + i % 7 * 90_001).cast("bigint").alias("listed_price_inr"), (1 + i % 5).cast("int").alias("copies"),
    )
    rows = once.withColumn("key", F.explode(F.sequence(F.lit(1), "copies"))).withColumn("one", F.lit(1.0)).cache()
    given, fitted = [], pricing_model.GBTRegressor.fit
    monkeypatch.setattr(pricing_model.GBTRegressor, "fit", lambda self, df, *a: (given.append(df.count()), fitted(self, df, *a))[1])
    ours = pricing_model.fit(rows, iterations=10, depth=4, snapshot_year=2020)
    plain = pricing_model.fit(rows, iterations=10, depth=4, snapshot_year=2020, weight="one")
    assert given == [240, 720]
    both = zip(*[m.predict(once.orderBy("listed_price_inr", "km_driven")).collect() for m in (ours, plain)], strict=True)
    assert all(abs(a.predicted_price_inr - b.predicted_price_inr) < 1e-6 * b.predicted_price_inr for a, b in both)
    assert abs(ours.overall - plain.overall) < 1e-9
    for mine, theirs in ((ours.encodings, plain.encodings), (ours.counts, plain.counts)):
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.collect()))
    few = pricing_model.fit(rows.limit(20), iterations=1, depth=2, snapshot_year=2020)  # no two sides of 15 rows
    assert few.pipeline.stages[-1].trees[0].numNodes == 1


def test_price_model_reads_all_rows_once(spark, monkeypatch):
    """only the merging pass reads every row; medians, categories and predictions come from merged rows."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import StringIndexer

    i = F.col("id")
    once = spark.range(120).select(
        *[F.when(i % 13 != 0, F.concat(F.lit(n), (i * 7 % m).cast("string"))).alias(n) for n, m in (("source", 3), ("city", 5), ("brand", 4), ("model", 6), ("variant", 9), ("registration_code", 4), ("fuel_type", 2), ("transmission", 2))],
        F.when(i % 17 != 0, 2008 + i % 9).cast("int").alias("model_year"), F.when(i % 11 != 0, i * 731 % 1009 * 100).alias("km_driven"), (100_000 + i * 1777).alias("listed_price_inr"), (1 + i % 5).cast("int").alias("copies"),
    )
    counted, at = spark.sparkContext.accumulator(0), F.monotonically_increasing_id()
    seen = F.udf(lambda x: (counted.add(1), x)[1], "bigint").asNondeterministic()
    rows = once.withColumn("key", F.explode(F.sequence(F.lit(1), "copies"))).withColumn("n", at).cache()
    model = pricing_model.fit(rows.withColumn("listed_price_inr", seen("listed_price_inr")), iterations=2, depth=3, snapshot_year=2020)
    assert counted.value == rows.count() == 360

    typed = pricing_model._typed(features.engineered(rows, 2020))
    middle = pricing_model.medians(typed).first()
    for c in pricing_model.NUMERIC:
        values = sorted(r[0] for r in typed.select(c).collect() if r[0] is not None)
        assert middle[c] == values[(len(values) - 1) // 2]
    merged = features.engineered(pricing_model.merged_rows(rows), 2020)
    assert pricing_model.medians(pricing_model._typed(merged), pricing_model.TIMES).first() == middle
    indexed = StringIndexer(inputCols=pricing_model.CATEGORICAL, outputCols=[f"x_{c}" for c in pricing_model.CATEGORICAL], stringOrderType="frequencyDesc").fit(typed)
    assert pricing_model.labels(merged, pricing_model.TIMES) == pricing_model.labels(rows.transform(features.engineered, 2020)) == [list(x) for x in indexed.labelsArray]

    given, transform = [], PipelineModel.transform
    monkeypatch.setattr(PipelineModel, "transform", lambda self, df, *a: (given.append(df.count()), transform(self, df, *a))[1])
    each, all_once = (sorted(map(tuple, model.predict(rows, once=o).select("n", "predicted_price_inr").collect()), key=lambda r: r[0]) for o in (False, True))
    assert each == all_once and len(each) == 360 and given == [360, 120]
    assert {r.n: r.city for r in model.predict(rows, once=True).collect()} == {r.n: r.city for r in rows.collect()}


def test_split_by_digits(spark):
    """the split compares digits of the hash, for the same rows as its share."""
    from lotlens.functions import scalars

    for share in (-0.1, 0.0, 1e-15, 0.2, 0.5, 1 / 3, 1.0, 1.5):
        x = spark.range(400).select(scalars.in_test("s", share, F.col("id").cast("string")).alias("a"), (scalars.hash_share("s", F.col("id").cast("string")) < share).alias("b"))
        assert x.filter("a IS DISTINCT FROM b").count() == 0, share


def test_request_rules(spark):
    row = spark.createDataFrame([("Audi", "", 1999, 10, "petrol", "manual", "x", "7")], "brand string, model string, model_year int, km_driven int, fuel_type string, transmission string, city string, ownership string")
    assert row.select(features.request_violations().alias("v")).first().v == ["missing_model", "model_year_out_of_range", "ownership_out_of_range"]


def test_runs_and_packages(spark, tmp_path):
    from lotlens.operators import metrics, scoring
    from lotlens.plans import packages

    run = adapters.Run("2026-06-24T10:00:00Z", "run", "Hyderabad", "Telangana")
    cards = [RAW["spinny"] | {"km": f"{40 + i}K km", "price": f"{4 + i}.03 Lakh", "ownership": "1st Owner", "listing_url": f"https://cars.example/buy-used-cars/x/honda/jazz/v-at-2016/{i}/"} for i in range(12)]
    paths = packages.run_payload(spark, payload(tmp_path, "spinny", cards), "spinny", run, 2026, str(tmp_path / "layers"), "2026-06-24")
    assert spark.read.json(paths["summary"]).first().run_ready
    seen = packages.observations(spark.read.parquet(paths["silver"]).drop("capture_date", "run_id")).withColumns({"run_id": F.lit("run"), "capture_date": F.lit("2026-06-24")})
    latest = [c for c in lifecycle.OBSERVATION_FIELDS if c in seen.columns and c not in ("listing_key", "run_id", "capture_date")] + ["listing_identity_basis", "vehicle_fingerprint"]
    rows = packages.modeling_rows(lifecycle.entities(seen, tuple(latest)).withColumns({"run_id": F.get("run_ids", F.lit(0)), "capture_date": F.get("capture_dates", F.lit(0))}), 2026)
    assert rows.columns == list(packages.MODELING_COLUMNS) and rows.count() == 12
    assert {r.status for r in packages.modeling_checks(rows, 12, 12).collect()} == {"pass"}
    packages.write_modeling_package(rows, str(tmp_path / "package"), 2026)
    assert spark.read.json(str(tmp_path / "package/metrics")).first().n == rows.filter("baseline_split = 'test'").count()
    told = json.loads(spark.read.text(str(tmp_path / "package/manifest"), wholetext=True).first()["value"])
    assert told["records_total"] == 12 == sum(told["split"].values()) and all((tmp_path / "package" / name).is_dir() for name in told["outputs"])
    assert "## Fields" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "package/eda_report")).collect())
    with pytest.raises(ValueError):
        packages.merged_metadata({}, {"totals": 1})
    ask = rows.limit(1).withColumn("fuel_type", F.lit("EV")).select("brand", "model", "model_year", "km_driven", "fuel_type", "transmission", "city")
    asked = scoring.requests(ask).first()
    assert asked.violations == [] and asked.fuel_type == "electric" and asked.source == "true_value" and asked.ownership == "unknown"
    got = scoring.graded(ask.withColumn("predicted_price_inr", F.lit(492808.0)), rows).first()
    assert got.confidence == "medium" and got.price_band == "2.5L_5L" and (got.low_price_inr, got.high_price_inr) == (404103, 581513)
    assert metrics.error_bands(F.lit(1.0))


def test_stream_keeps_entities_up_to_date(spark, tmp_path):
    from lotlens.streaming import entities

    for i, rows in enumerate([[("a", "t1"), ("b", "t2")], [("a", "t0"), ("c", "t3")]]):
        spark.createDataFrame(rows, "k string, at string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = entities.stream_entities(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, str(tmp_path / "out"), "k", "at", str(tmp_path / "log"))
    assert sorted(map(tuple, out.collect())) == [("a", 2, "t0", "t1"), ("b", 1, "t2", "t2"), ("c", 1, "t3", "t3")]

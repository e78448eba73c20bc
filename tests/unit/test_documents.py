"""Small documents, raw layers, manifests, the combined package and bounded reports."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.operators import adapters, pricing_model
from lotlens.plans import combined, manifests, packages
from lotlens.sources import documents, payloads, sinks, tables
from lotlens.streaming import entities, scroll

ROW = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def put(path, text):
    path.write_text(text)
    return str(path)


def test_objects_and_lists(spark, tmp_path):
    good, bad, listed = put(tmp_path / "o.json", '{"a": 1}'), put(tmp_path / "x.json", "{broken"), put(tmp_path / "l.json", ' \n[{"a": 1, "b": "x"}, {"a": 2}]')
    assert documents.read_object(spark, good) == {"a": 1} and documents.optional_object(spark, bad) == {} == documents.optional_object(spark, str(tmp_path / "none.json")) == documents.optional_object(spark, listed)
    with pytest.raises(ValueError, match="not a JSON object"):
        documents.read_object(spark, listed)
    assert [tuple(r) for r in documents.read_list(spark, listed, ROW).collect()] == [(1, "x"), (2, None)]
    with pytest.raises(ValueError, match="not a JSON list"):
        documents.read_list(spark, good, ROW)
    more = documents.read_details(spark, [listed, put(tmp_path / "m.json", '[{"a": 3}]')], ROW)
    assert more.count() == 3 and more.select("file").distinct().count() == 2


def test_registry_and_paths(spark, tmp_path):
    schema = "source string, role string, priority int"
    text = {"sources": {"one": {"role": "primary", "priority": 1}, "two": None}}
    rows = documents.read_registry(spark, put(tmp_path / "r.json", json.dumps(text)), "sources", schema)
    assert sorted(map(tuple, rows.collect())) == [("one", "primary", 1), ("two", None, None)]
    yaml = pytest.importorskip("yaml")
    assert documents.read_registry(spark, put(tmp_path / "r.yaml", yaml.safe_dump(text)), "sources", schema).count() == 2
    with pytest.raises(ValueError, match="no mapping"):
        documents.read_registry(spark, str(tmp_path / "r.json"), "other", schema)
    assert documents.resolve("r.json", "/nowhere", str(tmp_path)) == str(tmp_path / "r.json")
    assert documents.resolve("gone.json", "/x", "/y") == "/y/gone.json" and documents.resolve("s3://b/k", "/x") == "s3://b/k"
    assert documents.silver_path({"output_paths": {"silver": "p"}}) == "p"
    with pytest.raises(ValueError, match="run r1"):
        documents.silver_path({"run_id": "r1"})


def test_raw_layer_is_written_before_parsing(spark, tmp_path):
    raw = {"title": "2016 Honda Jazz", "price": "4.03 Lakh", "variant": "V AT", "km": "145.5K km", "fuel": "petrol", "transmission": "automatic", "registration": "TS12", "locality": "Hub"}
    path = put(tmp_path / "p.json", json.dumps({"source": "spinny", "source_url": "https://s/x", "records": [{"raw": raw}]}))
    run = adapters.Run("2026-06-24T10:00:00Z", "r1", "Hyderabad", "Telangana")
    out = packages.run_payload(spark, path, "spinny", run, 2026, str(tmp_path / "out"), "2026-06-24")
    row = spark.read.parquet(out["raw"]).first()
    assert (row["run_id"], row["source"], row["raw"]["title"]) == ("r1", "spinny", "2016 Honda Jazz") and set(out) == {"raw", "evaluated", "silver", "quarantine", "summary"}


def test_failures_beyond_those_listed_are_counted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(payloads, "SHOWN_FAILURES", 3)
    path = put(tmp_path / "p.json", json.dumps({"source": "spinny", "source_url": "u", "records": [{"raw": {"title": "x"}}] * 2}))
    with pytest.raises(ValueError, match="and 11 more"):
        payloads.checked_payload(spark, path, "spinny")


def test_reports_say_how_much_they_leave_out(spark):
    text = sinks.markdown_table(spark.range(30).orderBy("id"), "Numbers", 25)
    assert "| 24 |" in text and "| 25 |" not in text and text.endswith("5 more rows.\n")
    assert "more rows" not in sinks.markdown_table(spark.range(3), "Few")
    assert sinks.markdown_document("M", {"a": [1, 2], "b": {"c": None}}) == "## M\n\n- a: 1, 2\n\n### b\n\n- c: None\n\n"


def test_failed_capture(spark):
    row = manifests.failed_capture(spark.createDataFrame([("s", "r")], "source string, run_id string"), F.lit("timeout")).first()
    assert (row["ok"], row["error"], row["listing_records"]) == (False, "timeout", 0)


def package_rows(spark, n, origin):
    rows = spark.range(n).selectExpr("cast(id AS string) AS listing_key", f"'{origin}' AS source", "'Pune' AS city", "'Honda' AS brand", "concat('M', id % 3) AS model", "2018 AS model_year", "'petrol' AS fuel_type", "'manual' AS transmission", "1 AS ownership", "1000 * id AS km_driven", "100000 + 10 * id AS listed_price_inr")
    return rows


def test_combined_package(spark, tmp_path):
    live, other = package_rows(spark, 40, "spinny"), package_rows(spark, 60, "kaggle")
    put(tmp_path / "metrics.json", '{"mae": 5, "n": 1}')
    manifest = combined.write_package(live, other, str(tmp_path / "out"), (2026, 2021), (f"{tmp_path}/live.csv", "/nowhere/x.csv"))
    assert manifest["records_total"] == 100 and manifest["counts"]["dataset_origin"] == {"external": 60, "live": 40} and set(manifest["validation"].values()) == {"pass"}
    entries = {c["id"]: c for c in manifest["registry"]["candidates"]}
    assert entries["live"]["metrics"]["mae"] == 5 and entries["external"]["metrics"]["mae"] is None and entries["combined"]["metrics"]["mae"] is not None
    predicted = spark.read.parquet(f"{tmp_path}/out/predictions")
    assert 0 < predicted.count() == manifest["split"]["test_rows"] < 100 and {r.dataset_origin for r in predicted.collect()} <= {"live", "external"}
    assert documents.read_object(spark, f"{tmp_path}/out/manifest")["records_total"] == 100
    with pytest.raises(ValueError, match="price_positive"):
        combined.write_package(live.withColumn("listed_price_inr", F.lit(0)), other, str(tmp_path / "no"), (2026, 2021), ("a/b", "c/d"))
    assert not (tmp_path / "no").exists()


def test_importance_takes_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(pricing_model, "MOST_EVALUATED", 2)
    with pytest.raises(ValueError, match="at most 2 rows"):
        pricing_model.permutation_importance(None, spark.range(3), ["id"], "id")


def test_entity_versions_are_bounded(spark, tmp_path):
    table = entities.EntityTable(spark, str(tmp_path), "k", "at")
    for number in range(4):
        table.upsert(spark.createDataFrame([("a", f"t{number}"), (f"b{number}", "t9")], "k string, at string"), number)
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["v2", "v3"]
    table.upsert(spark.createDataFrame([("a", "t3"), ("b3", "t9")], "k string, at string"), 3)  # a replay
    assert {r.k: r.observation_count for r in table.read().collect()} == {"a": 4, "b0": 1, "b1": 1, "b2": 1, "b3": 1}


def test_scroll_until_nothing_is_new(spark, tmp_path):
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("pos", T.LongType())])
    state = scroll.NewRows(spark, str(tmp_path / "a"), "key", ["pos"], schema)
    pages = [[("a", 1), ("b", 2), ("a", 3), (None, 4)], [("b", 5), ("c", 6)], [("c", 7)], [("d", 8)]]
    for n, page in enumerate(pages):
        state.add(spark.createDataFrame(page, schema), n)
    state.add(spark.createDataFrame(pages[1], schema), 1)  # a replay
    assert sorted(map(tuple, state.rows().collect())) == [("a", 1), ("b", 2), ("c", 6)] and state.ended(4) == "no_new_rows"
    capped = scroll.NewRows(spark, str(tmp_path / "b"), "key", ["pos"], schema, most=3, most_each=2)
    for n, page in enumerate(pages):
        capped.add(spark.createDataFrame(page, schema), n)
    assert capped.found == {0: 2, 1: 1, 2: 0, 3: 0} and capped.ended(4) == "cap_reached"


def test_scroll_over_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, page in enumerate((["a", "b"], ["b", "c"], ["a"])):
        put(tmp_path / "in" / f"{n}.json", "\n".join(json.dumps({"key": k, "pos": n * 10 + i}) for i, k in enumerate(page)))
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("pos", T.LongType())])
    state = scroll.scroll(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "log"), "key", ["pos"])
    assert {r.key for r in state.rows().collect()} == {"a", "b", "c"} and sum(state.found.values()) == 3


def test_scratch_on_a_cluster_must_be_shared():
    session = lambda master, shared: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: shared or default), sparkContext=SimpleNamespace(master=master))
    assert tables.scratch(session("yarn", "hdfs://a/"), "x").startswith("hdfs://a/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.scratch(session("yarn", None), "x")

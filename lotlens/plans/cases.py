"""Queries that deal worked examples over a table: every text shape a parser must know, with the value it must give.

Row k of the table gets example ``k % n``, so a query reads and parses its whole table. The SQL side joins
the expected values, which are stated here as they are (fixed values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages
from ..functions import parsers as P
from ..functions import scalars as S
from ..operators import adapters
from ..sources import payloads
from ..sources.tables import table
from . import catalogue

KEY = "p_partkey"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int | float):
        return str(value).upper()
    return "'" + str(value).replace("'", "''") + "'"


def examples(name: str, columns: dict[str, str], rows: list[tuple], build) -> None:
    """Register ``name``: each row is (input, expected...); ``columns`` names the expected values and their SQL types.

    ``build`` turns the input column into one column for each expected value.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = F.array(*[F.lit(r[0]).cast("string") for r in rows])
        text = table(spark, sf_dir, "part").select(KEY, F.get(given, (F.col(KEY) % len(rows)).cast("int")).alias("text"))
        return text.select(KEY, build(F.col("text")).alias("r")).select(KEY, *[F.col(f"r.{c}").alias(c) for c in columns])

    run.__name__ = name
    expected = ", ".join("(" + ", ".join([str(i), *map(_literal, r[1:])]) + ")" for i, r in enumerate(rows))
    shown = ", ".join(f"CAST(c.{c} AS {kind}) AS {c}" for c, kind in columns.items())
    catalogue.QUERIES[name] = run
    catalogue.ORACLE_SQL[name] = f"SELECT {KEY}, {shown} FROM part JOIN (VALUES {expected}) c(nth, {', '.join(columns)}) ON {KEY} % {len(rows)} = c.nth"


def _parsed(parse, **more):
    """value, confidence, failure and warnings of a parser's struct."""

    def build(text: Column) -> Column:
        one = lambda r: F.struct(r["value"].alias("value"), r["confidence"].alias("confidence"), r["failure"].alias("failure"), F.array_join(r["warnings"], ",").alias("warnings"))
        return S.bind(parse(text, **more), one)

    return build


def _parts(parse, *names: str):
    """Fields of a parser's struct value, with confidence and failure."""

    def build(text: Column) -> Column:
        return S.bind(parse(text), lambda r: F.struct(*[r["value"][n].alias(n) for n in names], r["confidence"].alias("confidence"), r["failure"].alias("failure")))

    return build


JUDGED = {"confidence": "DOUBLE", "failure": "VARCHAR", "warnings": "VARCHAR"}

examples("clean_text_examples", {"value": "VARCHAR"}, [
    (None, None), (" NA ", None), ("--", None), ("  Hyundai   Creta  ", "Hyundai Creta"), ("Call for  Price", None), ("ask for price", None), ("N/A", None), ("none", None), ("None at all", "None at all"), ("0", "0"), ("\tnull\n", None),
], lambda c: F.struct(P.clean(c).alias("value")))

examples("search_text_examples", {"value": "VARCHAR"}, [
    ("₹5,75,000", "575000"), ("Petrol + CNG", "petrol cng"), ("A/B|C+D", "a b c d"), ("  Rs  1,2 ", "rs 12"), ("", ""), (None, None),
], lambda c: F.struct(P.searchable(c).alias("value")))

examples("price_examples", {"value": "BIGINT", **JUDGED}, [
    ("Rs 5.75L", 575000, 0.98, None, ""), ("5,75,000", 575000, 0.98, None, ""), ("1.02 Cr", 10200000, 0.98, None, ""),
    ("EMI Rs 12,000", 12000, 0.82, None, "price_text_contains_emi,price_below_soft_minimum"), ("8.98 Lakh Rs 9.25 Lakh", 898000, 0.9, None, "multiple_price_candidates"),
    ("n/a", None, 0.0, "missing_price", "missing_price"), ("Rs 0", None, 0.0, "invalid_price", "invalid_price"), ("4.03 lacs + charges", 403000, 0.9, None, "price_text_contains_extra_charges"),
    ("90 crore", 900000000, 0.9, None, "price_above_soft_maximum"), ("45 thousand only", 45000, 0.9, None, "price_below_soft_minimum"), ("₹ 7.5 lakhs", 750000, 0.98, None, ""), ("650k", 650000, 0.98, None, ""), ("best price", None, 0.0, "missing_price", "missing_price"), (None, None, 0.0, "missing_price", "missing_price"),
], _parsed(P.parse_price))

examples("km_examples", {"value": "BIGINT", **JUDGED}, [
    ("64K km", 64000, 0.96, None, ""), ("143.5K km", 143500, 0.96, None, ""), ("Driven 42,300 km", 42300, 0.96, None, ""), ("10 km or 20 km", 20, 0.96, None, ""), ("350,000 kms", 350000, 0.82, None, "km_above_soft_maximum"),
    ("600000 km", 600000, 0.82, "invalid_km", "km_above_soft_maximum,km_above_hard_maximum"), ("none", None, 0.0, "missing_km", "missing_km"), ("few kilometers", None, 0.0, "missing_km", "missing_km"), ("12 thousand kilometers", 12000, 0.96, None, ""),
], _parsed(P.parse_km))

examples("ownership_examples", {"value": "INTEGER", **JUDGED}, [
    ("First Owner", 1, 0.94, None, ""), ("Direct Owner", None, 0.4, "owner_text_is_seller_type_not_owner_count", "owner_text_is_seller_type_not_owner_count"), ("Direct Owner, second", 2, 0.94, None, ""), ("2nd", 2, 0.94, None, ""), ("owned by 4", 4, 0.94, None, ""),
    ("5th or 1st owner", 1, 0.94, None, ""), ("single", 1, 0.94, None, ""), ("three", 3, 0.94, None, ""), ("", None, 0.0, "missing_ownership", "missing_ownership"), ("someone", None, 0.0, "ambiguous_ownership_text", "ambiguous_ownership_text"),
], _parsed(P.parse_ownership))

examples("fuel_examples", {"value": "VARCHAR", **JUDGED}, [
    ("Petrol + CNG", "petrol_cng", 0.96, None, ""), ("Petrol+LPG", "petrol_lpg", 0.96, None, ""), ("EV", "electric", 0.96, None, ""), ("petrol hybrid", "hybrid", 0.78, None, "multiple_fuel_candidates"), ("steam", "unknown", 0.2, "unknown_fuel_type", "unknown_fuel_type"),
    ("Diesel", "diesel", 0.96, None, ""), ("gasoline", "petrol", 0.96, None, ""), ("petrol or diesel", "petrol", 0.78, None, "multiple_fuel_candidates"), ("cng", "cng", 0.96, None, ""), ("-", None, 0.0, "missing_fuel_type", "missing_fuel_type"),
], _parsed(P.parse_fuel))

examples("transmission_examples", {"value": "VARCHAR", **JUDGED}, [
    ("AMT", "amt", 0.96, None, ""), ("AT", "automatic", 0.96, None, ""), ("DSG", "dct", 0.96, None, ""), ("IMT", "imt", 0.96, None, ""), ("IVT", "ivt", 0.96, None, ""), ("5 speed", "unknown", 0.2, "unknown_transmission", "unknown_transmission"), ("MT", "manual", 0.96, None, ""),
    ("Automated Manual", "amt", 0.78, None, "multiple_transmission_candidates"), ("CVT automatic", "cvt", 0.78, None, "multiple_transmission_candidates"), ("matte", "unknown", 0.2, "unknown_transmission", "unknown_transmission"), (None, None, 0.0, "missing_transmission", "missing_transmission"),
], _parsed(P.parse_transmission))

examples("registration_examples", {"registration_code": "VARCHAR", "registration_state": "VARCHAR", "registration_type": "VARCHAR", "registration_year": "INTEGER", "confidence": "DOUBLE", "failure": "VARCHAR"}, [
    ("TS-07", "TS07", "Telangana", "state_rto", None, 0.95, None), ("TS07AB1234", "TS07", "Telangana", "state_rto", None, 0.95, None), ("Telangana", None, "Telangana", "state_rto", None, 0.7, None), ("22 BH 1234 AA", "BH", None, "bharat_series", 2022, 0.9, None),
    ("PORT BLAIR", "AN01", "Andaman and Nicobar Islands", "state_rto", None, 0.92, None), ("OR18", "OD18", "Odisha", "state_rto", None, 0.92, None), ("UA07", "UK07", "Uttarakhand", "state_rto", None, 0.92, None), ("OR", None, "Odisha", "state_rto", None, 0.72, None),
    ("CHENNAI", None, "Chandigarh", "state_rto", None, 0.75, None), ("ANDHRA PRADESH", None, "Andaman and Nicobar Islands", "state_rto", None, 0.75, None), ("CHHATTISGARH", None, "Chandigarh", "state_rto", None, 0.75, None),
    ("ka 5", "KA05", "Karnataka", "state_rto", None, 0.95, None), ("zz99", None, None, None, None, 0.2, "unknown_registration_prefix"), ("??", None, None, None, None, 0.2, "unknown_registration_prefix"), ("", None, None, None, None, 0.0, "missing_registration"),
], _parts(P.parse_registration, "registration_code", "registration_state", "registration_type", "registration_year"))

examples("title_examples", {"model_year": "INTEGER", "brand": "VARCHAR", "model": "VARCHAR", "variant": "VARCHAR", "confidence": "DOUBLE", "failure": "VARCHAR"}, [
    ("2021 Renault Kiger RXZ Turbo CVT", 2021, "Renault", "Kiger", "RXZ Turbo CVT", 0.9, None), ("2022 Maruti Vitara Brezza ZXI Plus Dual Tone", 2022, "Maruti Suzuki", "Vitara Brezza", "ZXI Plus Dual Tone", 0.9, None),
    ("2023 Mercedes GLA Class 200", 2023, "Mercedes-Benz", "GLA Class", "200", 0.9, None), ("2023 Mercedes Benz C Class", 2023, "Mercedes-Benz", "C-Class", None, 0.95, None), ("2023 Mahindra Scorpio N Z8", 2023, "Mahindra", "Scorpio N", "Z8", 0.9, None),
    ("2021 Hyundai Grand i10 Nios Asta", 2021, "Hyundai", "Grand i10 Nios", "Asta", 0.9, None), ("2016 Hyundai Fluidic Verna 4S SX", 2016, "Hyundai", "Fluidic Verna 4S", "SX", 0.9, None), ("2021 MG Hector Plus", 2021, "MG", "Hector Plus", None, 0.95, None),
    ("2021 MG Motors Astor", 2021, "MG", "Astor", None, 0.95, None), ("2021 Tata Tigor EV", 2021, "Tata", "Tigor EV", None, 0.95, None), ("2022 Maruti Suzuki Wagon-R-1-0", 2022, "Maruti Suzuki", "Wagon R", None, 0.95, None), ("2019 Maruti Suzuki Vitara-Brezza", 2019, "Maruti Suzuki", "Vitara Brezza", None, 0.95, None),
    ("2017 Nissan Micra Active", 2017, "Nissan", "Micra Active", None, 0.95, None), ("Maruti Suzuki Baleno Delta 2019", 2019, "Maruti Suzuki", "Baleno", "Delta", 0.9, None), ("2016 Dzire Maruti VXI", 2016, "Maruti Suzuki", "Swift Dzire", "VXI", 0.9, None), ("2018 mahindra XUV 500 W8 2 2", 2018, "Mahindra", "XUV500", "W8 2.2", 0.9, None),
    ("2012 Tata Nano 2015", 2012, "Tata", "Nano", "2015", 0.9, None), ("1985 Fiat Padmini", None, "Fiat", "1985", "Padmini", 0.7, "missing_model_year"), ("Honda City VX CVT Petrol", None, "Honda", "City", "VX CVT Petrol", 0.7, "missing_model_year"), ("2020 Rocket Ship", 2020, None, "Rocket", "Ship", 0.65, "unknown_brand"),
    ("2020 Honda", 2020, "Honda", None, None, 0.7, "unknown_model"), ("2016 Honda Jazz 1.2L", 2016, "Honda", "Jazz", None, 0.95, None), ("null", None, None, None, None, 0.0, "missing_title"),
], _parts(lambda c: P.parse_title(c, 2026), "model_year", "brand", "model", "variant"))

examples("price_like_examples", {"value": "BOOLEAN"}, [
    ("Rs 7.27 Lakh", True), ("₹7.27 Lakh", True), ("Style 1.0L TSI AT", False), (None, False), ("₹ 45,000", False), ("INR 45,000", True), ("12 crore flat", True), ("VXI", False), ("Rs. 500 off", True),
], lambda c: F.struct(P.price_like(c).alias("value")))

_CAR = "https://www.cars.example/buy-used-cars/bangalore/hyundai/"
examples("variant_url_examples", {"value": "VARCHAR"}, [
    (f"{_CAR}venue/sx-10-petrol-2019/29589252/", "SX 10 Petrol"), (f"{_CAR}grand-i10/sportz-o-12-kappa-vtvt-btm-layout-2018/30084370/", "Sportz (O) 12 Kappa VTVT"), (f"{_CAR}venue/", None), (f"{_CAR}i20/asta-12l-2020/1/", "Asta 1.2L"),
    (f"{_CAR}i20/12345/1/", None), ("https://www.cars.example/sell/x/y/z/w", None), (None, None), (f"{_CAR}creta/e%2Dplus-2021/7/?q=1", "E Plus"),
], lambda c: F.struct(P.variant_from_url(c).alias("value")))

examples("details_split_examples", {"variant": "VARCHAR", "km": "VARCHAR", "fuel": "VARCHAR", "transmission": "VARCHAR"}, [
    ("W8 | 50,000 km | Diesel | Manual", "W8", "50,000 km", "Diesel", "Manual"), ("W8|1 km", "W8", "1 km", None, None), ("| | Petrol |", None, None, "Petrol", None), ("NA | - | Diesel | AT | more", None, None, "Diesel", "AT"), (None, None, None, None, None),
], P.split_details)

_CARD = "Top pick\n2016 Honda Jazz\n₹4.03 Lakh\nEMI Rs 7,013/m*\nV AT Petrol\n145.5K km\nPetrol\nAutomatic\nTS12\nGreat quality, rated\nKukatpally, Hyderabad\n"
_BARE = "2019 Tata Nexon\n9 lakh\n30K km\ndiesel\nmanual\n22 BH 1234\n"
examples("card_text_examples", {n: "VARCHAR" for n in ("title", "price", "variant", "emi", "km", "fuel", "transmission", "registration", "locality")}, [
    (_CARD, "2016 Honda Jazz", "₹4.03 Lakh", "V AT Petrol", "EMI Rs 7,013/m*", "145.5K km", "petrol", "automatic", "TS12", "Kukatpally, Hyderabad"), (_BARE, "2019 Tata Nexon", "9 lakh", "", "", "30K km", "diesel", "manual", "22 BH 1234", "Hub"),
    ("2016 Honda Jazz\n4 Lakh", None, None, None, None, None, None, None, None, None), (_BARE.replace("diesel\nmanual", "manual\ndiesel"), None, None, None, None, None, None, None, None, None), ("", None, None, None, None, None, None, None, None, None),
], lambda c: pages.parse_card(c, "Hub"))

_PAGE = "Car Overview\nMake Year\nMar 2019\nNo. of Owner\n1st Owner\nRTO\nTS12\nQuality report\n200 parts evaluated\nCore systems\n9.1\nexcellent\nWear & tear parts\nfair\n1\nWarranty\n5-day money back offer\nNext service due in May"
_DETAIL = {n: "VARCHAR" for n in ("make_year", "ownership", "rto", "fuel", "core_score", "core_grade", "wear_grade", "inspection_status", "inspection_summary", "warranty_label", "return_policy_label", "service_due_text")}


def _detail(text: Column) -> Column:
    def shown(d: Column) -> Column:
        core, wear = d["quality_scores"]["core_systems"], d["quality_scores"]["wear_tear_parts"]
        said = [d[n].alias(n) for n in ("make_year", "ownership", "rto", "fuel", "inspection_status", "inspection_summary", "warranty_label", "return_policy_label", "service_due_text")]
        return F.struct(*said, core["score"].alias("core_score"), core["grade"].alias("core_grade"), wear["grade"].alias("wear_grade"))

    return S.bind(pages.parse_detail(text), shown)


examples("detail_text_examples", _DETAIL, [
    (_PAGE, "Mar 2019", "1st Owner", "TS12", None, "9.1", "excellent", "fair", "quality_report_available", "200 parts evaluated", "1 warranty", "5-day money back", "Next service due in May"),
    ("FUEL TYPE\nDiesel\n1-year warranty on engine", None, None, None, "Diesel", None, None, None, None, None, "1-year warranty", None, None), ("nothing here", *[None] * 12), ("", *[None] * 12),
], _detail)

examples("year_examples", {"value": "INTEGER"}, [("Jan 2019", 2019), ("x", None), (None, None), ("1899 then 1999 and 2001", 1999), ("12019", None), ("(2021)", 2021), ("20190", None), ("A2019", None)], lambda c: F.struct(P.parse_year(c).alias("value")))

examples("alias_examples", {"value": "VARCHAR"}, [("Petrol-CNG", "petrol_cng"), (" AT ", "automatic"), ("Semi Auto", "semi_auto"), ("mt", "manual"), (None, None)], lambda c: F.struct(P.alias(c, {"at": "automatic", "mt": "manual"}).alias("value")))

examples("whole_number_examples", {"plain": "BIGINT", "or_zero": "BIGINT", "truncated": "BIGINT", "half_even": "BIGINT", "real": "DOUBLE"}, [
    ("1,200", 1200, 1200, 1200, None, 1200.0), ("650000.0", None, 0, 650000, 650000, 650000.0), ("12.5", None, 0, 12, 12, 12.5), ("-2.7", None, 0, -2, -3, -2.7), ("3.5", None, 0, 3, 4, 3.5), ("x", None, 0, None, None, None), (None, None, 0, None, None, None), ("+7", 7, 7, 7, 7, 7.0), ("45%", None, 0, None, None, 45.0),
], lambda c: F.struct(S.int_or_null(c).alias("plain"), S.int_or_zero(c).alias("or_zero"), S.int_truncated(c).alias("truncated"), S.int_half_even(c).alias("half_even"), S.float_or_null(c, percent=True).alias("real")))

examples("url_token_examples", {"url": "VARCHAR", "token": "VARCHAR"}, [
    ("HTTPS://A.Com//b//c/?q#f", "https://a.com/b/c", "https a com b c q f"), ("", "", ""), (None, "", ""), ("http://x.y/", "http://x.y", "http x y"), ("//Host/Path", "https://host/Path", "host path"), ("a/b", "https:///a/b", "a b"), (" A-b  C! ", "https:///A-b  C!", "a b c"),
], lambda c: F.struct(S.normal_url(c).alias("url"), S.token(c).alias("token")))

examples("money_text_examples", {"value": "VARCHAR"}, [("12500000", "1.25 Cr"), ("650000", "6.50 L"), ("9999", "9,999"), ("100000", "1.00 L")], lambda c: F.struct(S.money_text(c.cast("bigint")).alias("value")))

examples("warranty_examples", {"value": "VARCHAR"}, [("1Y", "1 year warranty"), ("2y", "2 years warranty"), ("6M", "6 months warranty"), ("0M", None), ("NO", None), ("Extended", "Extended"), (None, None)], lambda c: F.struct(adapters.warranty(c).alias("value")))

examples("noisy_json_examples", {"value": "VARCHAR"}, [('x{"a":{"b":"}"}} tail', '{"a":{"b":"}"}}'), ("none", None), ("{open", None), ('{"a":"\\""} {"b":1}', '{"a":"\\""}'), ("{}", "{}")], lambda c: F.struct(payloads.first_json_object(c).alias("value")))


# --- canonical projection of the second and third source -----------------------------------------------

_RUN = adapters.Run("2026-06-24T10:00:00Z", "run", "Hyderabad", "Telangana")
_CANONICAL = {
    "source_listing_id": "VARCHAR", "listing_url": "VARCHAR", "brand": "VARCHAR", "model": "VARCHAR", "variant": "VARCHAR", "model_year": "INTEGER", "listed_price_inr": "BIGINT", "km_driven": "BIGINT", "fuel_type": "VARCHAR", "transmission": "VARCHAR", "ownership": "INTEGER",
    "registration_code": "VARCHAR", "seller_type": "VARCHAR", "is_certified": "BOOLEAN", "inspection_status": "VARCHAR", "warranty_label": "VARCHAR", "locality": "VARCHAR", "is_available": "BOOLEAN", "parse_confidence": "DOUBLE", "parse_warnings": "VARCHAR",
}


def canonical_examples(name: str, source: str, rows: list[tuple[dict, tuple]]) -> None:
    """Raw records dealt over a table and the canonical values each must give."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        record = lambda given: F.struct(*[F.lit(given.get(n)).cast("string").alias(n) for n in adapters.raw_fields(source)])
        dealt = F.get(F.array(*[record(given) for given, _ in rows]), (F.col(KEY) % len(rows)).cast("int"))
        out = adapters.canonical(table(spark, sf_dir, "part").select(F.col(KEY).alias("index"), F.lit("https://www.site.example/x").alias("source_url"), dealt.alias("raw")), source, _RUN, 2026)
        return out.select(F.col("index").alias(KEY), *[F.array_join(c, ",").alias(c) if c == "parse_warnings" else F.col(c) for c in _CANONICAL])

    run.__name__ = name
    expected = ", ".join("(" + ", ".join([str(i), *map(_literal, want)]) + ")" for i, (_, want) in enumerate(rows))
    shown = ", ".join(f"CAST(c.{c} AS {kind}) AS {c}" for c, kind in _CANONICAL.items())
    catalogue.QUERIES[name] = run
    catalogue.ORACLE_SQL[name] = f"SELECT {KEY}, {shown} FROM part JOIN (VALUES {expected}) c(nth, {', '.join(_CANONICAL)}) ON {KEY} % {len(rows)} = c.nth"


canonical_examples("canonical_projection_structured_source", "mahindra_first_choice", [
    ({"score": "8.5", "title": "2019 Mahindra XUV500", "variant_details": "W8 | 50,000 km | Diesel | Manual", "price": "9.5 Lakh", "locality": "Pune", "id_classified": "77"},
     ("mfc_77", "https://www.site.example/x#record-1", "Mahindra", "XUV500", "W8", 2019, 950000, 50000, "diesel", "manual", None, None, "dealer", True, "mfc_certified_public_card", None, "Pune", True, 0.95, "")),
    ({"score": "7", "title": "Rocket", "model_year": "2018", "brand": "Kia", "model": "Seltos", "variant": "HTK", "km": "12K km", "fuel": "petrol", "transmission": "AT", "price": "10 lakh", "owner_text": "2nd owner", "registration_number": "MH12AB1", "stock_id": "S9", "seller_type": "Broker",
      "is_certified": "no", "listing_url": "https://www.site.example/k", "locality": "Goa"},
     ("mfc_stock_S9", "https://www.site.example/k", "Kia", "Seltos", "HTK", 2018, 1000000, 12000, "petrol", "automatic", 2, "MH12", "broker", False, "mfc_certified_public_card", None, "Goa", True, 0.96, "")),
])
# the first record's URL falls back to its number, which the SQL spells out from the key
catalogue.ORACLE_SQL["canonical_projection_structured_source"] = catalogue.ORACLE_SQL["canonical_projection_structured_source"].replace("CAST(c.listing_url AS VARCHAR)", f"replace(c.listing_url, '#record-1', '#record-' || {KEY})")

canonical_examples("canonical_projection_attribute_source", "true_value", [
    ({"sku": "S1", "title": "2018 Maruti Swift VXI", "price": "550000", "model_year": "2018", "model": "Swift", "variant": "VXI", "km": "42,000 km", "fuel": "Petrol", "transmission": "MT", "ownership": "1", "registration": "TS07", "locality": "Hyd", "warranty_info": "1Y", "true_value_certified": "CR", "url_key": "swift-1", "in_stock": "true"},
     ("true_value_S1", "https://www.site.example/swift-1", "Maruti Suzuki", "Swift", "VXI", 2018, 550000, 42000, "petrol", "manual", 1, "TS07", "oem_dealer", True, "true_value_certified", "1 year warranty", "Hyd", True, 0.9, "variant_inferred")),
    ({"external_id": "E2", "title": "Alto 800", "price": "0", "model_year": "2015", "model": "Alto 800", "km": "9 km", "fuel": "steam", "transmission": "MT", "owner_text": "Direct Owner", "registration": "zz", "dealer_location": "Ring Road", "dms_certification_status": "Pending", "in_stock": "no", "listing_url": "https://www.site.example/a"},
     ("true_value_external_E2", "https://www.site.example/a", "Maruti Suzuki", "Alto", "800", 2015, None, 9, "unknown", "manual", None, None, "oem_dealer", False, "true_value_status_pending", None, "Ring Road", False, 0.0,
      "missing_model_year,unknown_brand,variant_inferred,invalid_price,unknown_fuel_type,unknown_registration_prefix")),
])

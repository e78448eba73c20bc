"""Raw payload records of three sources to the canonical listing, with each source's payload contract.

Input: index (1-based), source_url and raw, a struct with at least the source's columns (see
``sources.payloads``). A source is a declarative mapping of canonical columns to expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsers as P
from ..functions.scalars import first_filled

# Raw fields that a source's contract requires, and those kept as extra fields.
REQUIRED_RAW = {
    "spinny": ("title", "price", "variant", "km", "fuel", "transmission", "registration", "locality"),
    "mahindra_first_choice": ("score", "title", "variant_details", "price", "locality"),
    "true_value": ("sku", "title", "price", "model_year", "model", "variant", "km", "fuel", "transmission", "ownership", "registration", "locality"),
}
EXTRA_RAW = {
    "spinny": ("insurance_validity", "insurance_type", "inspection_summary", "quality_scores", "service_due_text"),
    "mahindra_first_choice": ("score", "variant_details", "id_classified", "stock_id", "photo_count", "mileage", "source_price_value", "source_city", "source_state", "emi"),
    "true_value": ("sku", "external_id", "url_key", "dealer_code", "dealer_location", "dms_certification_status", "registration_date", "warranty_info", "overall_rating"),
}
MORE_RAW = {
    "spinny": ("emi", "rto", "ownership", "listing_url", "detail_locality", "make_year", "registration_year", "inspection_status", "warranty_label", "return_policy_label"),
    "mahindra_first_choice": ("km", "fuel", "transmission", "owner_text", "ownership", "registration", "registration_number", "variant", "model_year", "brand", "model", "listing_url", "body_type", "color", "seller_type", "dealer_name", "is_certified", "warranty_label", "listing_posted_at"),
    "true_value": ("owner_text", "emi", "listing_url", "city", "make_year", "body_type", "color", "currency", "dealer_name", "true_value_certified", "in_stock", "listing_posted_at", "mssf_finance"),
}


def raw_fields(source: str) -> list[str]:
    """All raw fields, as text, that a source's adapter reads."""
    return list(dict.fromkeys(REQUIRED_RAW[source] + EXTRA_RAW[source] + MORE_RAW[source]))


@dataclass(frozen=True)
class Run:
    """What a run says about all its records."""

    captured_at: str
    run_id: str
    city: str
    state: str
    parser_version: str = "listing_adapter_v1"
    schema_version: str = "canonical_listing_v0.1"


def raw(name: str) -> Column:
    return F.col(f"raw.{name}")


def truthy(c: Column, default: bool, *more: str) -> Column:
    """A flag in text; ``default`` where there is none."""
    text = F.lower(P.clean(c))
    return F.when(text.isNull(), F.lit(default)).otherwise(text.isin("1", "true", "yes", "y", *more))


def contract(df: DataFrame, source: str) -> DataFrame:
    """Violations of the payload contract: (record_index, field_name, reason); record 0 is the payload."""
    mark = lambda c, field, reason: F.when(c, F.struct(F.col("index").alias("record_index"), F.lit(field).alias("field_name"), F.lit(reason).alias("reason")))
    tests = [mark(F.col("raw").isNull(), "raw", "raw_must_be_object")]
    tests += [mark(P.clean(raw(f)).isNull(), f, "missing_required_raw_field") for f in REQUIRED_RAW[source]]
    if source == "mahindra_first_choice":
        score = P.clean(raw("score")).try_cast("double")
        tests.append(mark(~F.coalesce(score.between(0, 10), F.lit(False)), "score", "score_must_be_decimal_0_to_10"))
        parts = P.split_details(raw("variant_details"))
        tests += [mark(parts[n].isNull(), f"variant_details.{n}", "missing_variant_detail_segment") for n in ("variant", "km", "fuel", "transmission")]
    if source == "true_value":
        tests.append(mark(~F.coalesce(raw("price").try_cast("bigint") > 0, F.lit(False)), "price", "price_must_be_positive_number"))
    return df.select(F.explode(F.array_compact(F.array(*tests))).alias("v")).select("v.*")


def header_failures(source: str, source_url: str | None, records: int, said: str | None) -> list[tuple[int, str, str]]:
    """Contract failures of the payload itself."""
    out = [(0, "source", "unexpected_source")] if said != source else []
    out += [(0, "source_url", "missing_source_url")] if not source_url else []
    return out + ([(0, "records", "records_must_be_non_empty_array")] if records == 0 else [])


def format_failures(failures: list[tuple[int, str, str]]) -> str:
    return "; ".join(f"{f'record {i}' if i else 'payload'} {field}: {reason}" for i, field, reason in failures)


def raw_hash(df: DataFrame) -> Column:
    """SHA-256 of the raw record's JSON with fields in the order of their names and nulls left out.

    A hash of this library's own: it is stable across runs and engines that keep this rule.
    """
    names = sorted(f.name for f in df.schema["raw"].dataType.fields)
    return F.sha2(F.to_json(F.struct(*[F.col(f"raw.{n}").alias(n) for n in names])), 256)


def _source_id(source: str, digest: Column) -> Column:
    plain = lambda prefix: F.concat(F.lit(prefix), F.lit("_"), F.lpad(F.col("index").cast("string"), 3, "0"), F.lit("_"), F.substring(digest, 1, 8))
    named = lambda prefix, c: F.concat(F.lit(prefix), P.clean(c))
    if source == "mahindra_first_choice":
        return F.coalesce(named("mfc_", raw("id_classified")), named("mfc_stock_", raw("stock_id")), plain("mahindra_first_choice_extracted"))
    if source == "true_value":
        return F.coalesce(named("true_value_", raw("sku")), named("true_value_external_", raw("external_id")), plain("true_value_extracted"))
    return plain("spinny_extracted")


def _url(source: str) -> Column:
    number = F.concat(F.col("source_url"), F.lit("#record-"), F.col("index").cast("string"))
    if source != "true_value":
        return F.coalesce(first_filled(raw("listing_url")), number)
    site = F.regexp_extract(F.coalesce("source_url", F.lit("")), r"^([a-zA-Z]+://[^/]+)", 1)
    return F.coalesce(first_filled(raw("listing_url")), F.concat(site, F.lit("/"), P.clean(raw("url_key"))), F.concat(F.col("source_url"), F.lit("#record-"), F.coalesce(raw("sku"), F.lit("unknown"))))


def warranty(c: Column) -> Column:
    text = P.clean(c)
    up = F.upper(text)
    n = F.substr(up, F.lit(1), F.char_length(up) - 1)
    label = F.when(up.isin("0M", "0", "NO", "N"), F.lit(None).cast("string")).when(up.endswith("Y"), F.concat(n, F.when(n == "1", " year warranty").otherwise(" years warranty")))
    return label.when(up.endswith("M"), F.concat(n, F.lit(" months warranty"))).otherwise(text)


def _variant(source: str, title: Column) -> tuple[Column, Column]:
    """The variant and the warnings about where it came from."""
    none = F.array().cast("array<string>")
    if source == "mahindra_first_choice":
        return F.coalesce(first_filled(raw("variant")), P.split_details(raw("variant_details"))["variant"], title["variant"]), none
    if source == "true_value":
        return F.coalesce(first_filled(raw("variant")), title["variant"]), none
    own, url, head = P.clean(raw("variant")), P.variant_from_url(raw("listing_url")), P.clean(title["variant"])
    good, priced = own.isNotNull() & ~P.price_like(own), own.isNotNull() & P.price_like(own)
    from_where = F.when(url.isNotNull(), "variant_recovered_from_listing_url").when(head.isNotNull(), "variant_recovered_from_title")
    return F.when(good, own).otherwise(F.coalesce(url, head)), F.when(good, none).otherwise(P.strings(P.flag(priced, "variant_price_text_rejected"), from_where))


def canonical(df: DataFrame, source: str, run: Run, as_of_year: int) -> DataFrame:
    """The canonical listings of a checked payload."""
    mfc, tv = source == "mahindra_first_choice", source == "true_value"
    details = P.split_details(raw("variant_details")) if mfc else None
    either = lambda name: F.coalesce(first_filled(raw(name)), details[name]) if mfc else raw(name)
    registration = F.coalesce(first_filled(raw("rto")), raw("registration")) if source == "spinny" else F.coalesce(first_filled(raw("registration")), raw("registration_number")) if mfc else raw("registration")
    owner = {"spinny": raw("ownership"), "true_value": F.coalesce(first_filled(raw("ownership")), raw("owner_text") if tv else F.lit(None))}.get(source, F.coalesce(first_filled(raw("owner_text")), raw("ownership")) if mfc else None)
    parsed = df.select("*", raw_hash(df).alias("hash"), P.parse_title(raw("title"), as_of_year).alias("title"), P.parse_price(raw("price")).alias("price"), P.parse_km(either("km")).alias("km"), P.parse_fuel(either("fuel")).alias("fuel"),
                       P.parse_transmission(either("transmission")).alias("box"), P.parse_registration(registration).alias("reg"), P.parse_ownership(owner).alias("owner"), P.parse_price(raw("emi")).alias("emi"))
    structured = P.clean(raw("model_year")).isNotNull() & P.clean(raw("brand")).isNotNull() & P.clean(raw("model")).isNotNull() if mfc else F.lit(False)
    title = F.col("title.value")
    variant, variant_warnings = _variant(source, title)
    used = ["price", "km", "fuel", "box"] if mfc else ["title", "price", "km", "fuel", "box", "reg"]
    confidence = [F.col(f"{u}.confidence") for u in used] + ([F.when(structured, 0.98).otherwise(F.col("title.confidence"))] if mfc else [])
    said = [F.col(f"{u}.warnings") for u in used] + ([F.when(structured, F.array().cast("array<string>")).otherwise(F.col("title.warnings"))] if mfc else []) + [variant_warnings]
    text = lambda x: F.lit(x).cast("string")
    pick = lambda c, *names: raw(c) if source in names else text(None)
    extra = F.map_filter(F.create_map(*[x for n in EXTRA_RAW[source] for x in (F.lit(n), raw(n).cast("string"))]), lambda k, v: v.isNotNull() & (v != ""))
    certified = F.lit(True) if source == "spinny" else truthy(raw("is_certified"), True, "certified") if mfc else truthy(raw("true_value_certified"), False, "certified", "cr")
    status = raw("inspection_status") if source == "spinny" else text("mfc_certified_public_card")
    if tv:
        dms = F.lower(P.clean(raw("dms_certification_status")))
        status = F.when(certified, "true_value_certified").when(dms.isNotNull(), F.concat(F.lit("true_value_status_"), dms)).otherwise("true_value_inventory")
    ok = lambda c: F.when(F.col(f"{c}.failure").isNull(), F.col(f"{c}.value"))
    financed = F.coalesce(raw("emi") != "", F.lit(False)) | (F.coalesce(raw("mssf_finance") == "1", F.lit(False)) if tv else F.lit(False))
    columns = {
        "source": text(source), "source_listing_id": _source_id(source, F.col("hash")), "listing_url": _url(source), "captured_at": text(run.captured_at), "city": text(run.city), "state": text(run.state),
        "locality": F.coalesce(first_filled(raw("detail_locality")), raw("locality")) if source == "spinny" else raw("locality") if mfc else first_filled(raw("locality"), raw("dealer_location"), raw("city")),
        "hub_name": first_filled(raw("dealer_location"), raw("locality")) if tv else raw("locality"),
        "brand": F.when(structured, raw("brand")).otherwise(title["brand"]) if mfc else F.coalesce(title["brand"], text("Maruti Suzuki") if tv else text(None)),
        "model": F.when(structured, raw("model")).otherwise(title["model"]) if mfc else F.coalesce(title["model"], raw("model") if tv else text(None)), "variant": variant,
        "model_year": F.when(structured, raw("model_year").try_cast("int")).otherwise(title["model_year"]) if mfc else F.coalesce(title["model_year"], raw("model_year").try_cast("int") if tv else F.lit(None).cast("int")),
        "manufacture_year": P.parse_year(first_filled(raw("make_year"), raw("model_year")) if tv else pick("make_year", "spinny")), "registration_year": P.parse_year(raw("registration_date") if tv else pick("registration_year", "spinny")),
        "fuel_type": F.col("fuel.value"), "transmission": F.col("box.value"), "km_driven": F.col("km.value"), "ownership": ok("owner"),
        "registration_state": F.col("reg.value.registration_state"), "registration_code": F.col("reg.value.registration_code"), "registration_type": F.col("reg.value.registration_type"),
        "body_type": text(None) if source == "spinny" else raw("body_type"), "color": text(None) if source == "spinny" else raw("color"), "listed_price_inr": F.col("price.value"), "emi_amount_inr": ok("emi"),
        "currency": F.coalesce(first_filled(raw("currency")), text("INR")) if tv else text("INR"), "seller_type": text("platform") if source == "spinny" else text("oem_dealer") if tv else F.coalesce(F.lower(P.clean(raw("seller_type"))), text("dealer")),
        "dealer_name": text(None) if source == "spinny" else raw("dealer_name"), "is_certified": certified, "inspection_status": status, "finance_label": F.when(financed, "finance_available"),
        "warranty_label": warranty(raw("warranty_info")) if tv else raw("warranty_label"), "return_policy_label": pick("return_policy_label", "spinny"), "is_available": truthy(raw("in_stock"), True) if tv else F.lit(True),
        "listing_posted_at": text(None) if source == "spinny" else raw("listing_posted_at"), "source_record_type": text("listing"), "source_title_text": raw("title"), "source_variant_text": raw("variant_details") if mfc else raw("variant") if tv else variant,
        "raw_record_hash": F.col("hash"), "ingestion_run_id": text(run.run_id), "parser_version": text(run.parser_version), "schema_version": text(run.schema_version),
        "parse_confidence": F.least(*confidence), "parse_warnings": F.concat(*said), "extra_fields": extra,
    }
    return parsed.select("index", *[c.alias(n) for n, c in columns.items()])

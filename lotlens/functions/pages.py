"""Fields from the visible text of listing cards and detail pages, as Column functions over lines.

A card is read in order: headline, price, distance, fuel, gearbox, registration, each the first fitting
line after the one before. A detail page is read by labels: a value stands on the line after its label.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .scalars import bind

# How lines of each kind look, labels of detail values, and sub-scores of a quality report.
PRICE_LINE = r"(?i)^(?:rs\.?\s*|inr\s*)?\d+(?:\.\d+)?\s*(?:lakh|lac|cr|crore)\b"
KM_LINE = r"(?i)\b\d+(?:\.\d+)?K?\s*km\b"
HEADLINE = r"^(19|20)\d{2}\s+\S+"
PLATE_LINE = r"(?i)^(?:[A-Z]{2}\s*\d{1,2}[A-Z]{0,2}|\d{2}\s*BH\b)"
FUEL_LINES = ("petrol", "diesel", "cng", "electric", "hybrid", "petrol + cng", "petrol/cng")
GEARBOX_LINES = ("automatic", "manual", "amt", "cvt", "dct")
DETAIL_LABELS = {
    "make_year": "make year", "registration_year": "registration year", "fuel": "fuel type", "km": "km driven", "transmission": "transmission", "ownership": "no. of owner",
    "insurance_validity": "insurance validity", "insurance_type": "insurance type", "rto": "rto", "detail_locality": "car location",
}
SCORE_LABELS = {"Core systems": "core_systems", "Supporting systems": "supporting_systems", "Interiors & AC": "interiors_ac", "Exteriors & lights": "exteriors_lights", "Wear & tear parts": "wear_tear_parts"}


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != "")


def _first(lines: Column, test, after: Column) -> Column:
    """The 0-based place of the first line behind ``after`` that passes; null if none does."""
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    return F.get(F.filter(places, lambda i: (i > after) & test(F.get(lines, i))), F.lit(0))


def _price(x: Column) -> Column:
    return F.replace(x, F.lit("₹"), F.lit("Rs ")).rlike(PRICE_LINE)


def _km(x: Column) -> Column:
    return x.rlike(KM_LINE)


def parse_card(text: Column, locality: str = "") -> Column:
    """struct of nine raw fields of a card, or null where one of the six ordered lines is missing."""
    ordered = (
        ("title", lambda x: x.rlike(HEADLINE)), ("price", _price), ("km", _km), ("fuel", lambda x: F.lower(x).isin(*FUEL_LINES)),
        ("transmission", lambda x: F.lower(x).isin(*GEARBOX_LINES)), ("registration", lambda x: x.rlike(PLATE_LINE)),
    )

    def found(lines: Column) -> Column:
        def walk(rest, places: dict[str, Column]):
            if not rest:
                return built(lines, places)
            (name, test), *others = rest
            after = list(places.values())[-1] if places else F.lit(-1)
            return bind(_first(lines, test, after), lambda at: walk(others, places | {name: at}))

        return F.when(F.size(lines) > 0, walk(list(ordered), {}))

    def built(lines: Column, at: dict[str, Column]) -> Column:
        line = lambda n: F.get(lines, at[n])
        between = F.slice(lines, at["price"] + 2, F.greatest(at["km"] - at["price"] - 1, F.lit(0)))
        emi = F.get(F.filter(between, lambda x: F.lower(x).startswith("emi")), F.lit(0))
        variant = F.get(F.filter(between, lambda x: ~F.lower(x).startswith("emi") & ~_price(x) & ~_km(x)), F.lit(0))
        below = F.slice(lines, at["registration"] + 2, F.lit(3))
        place = F.get(F.filter(below, lambda x: x.contains(",") & ~x.rlike(r"(?i)\b(reason|rating|benefit|quality|luxury)\b")), F.lit(0))
        fields = {"title": line("title"), "price": line("price"), "variant": F.coalesce(variant, F.lit("")), "emi": F.coalesce(emi, F.lit("")), "km": line("km"), "fuel": F.lower(line("fuel")), "transmission": F.lower(line("transmission")), "registration": line("registration"), "locality": F.coalesce(place, F.lit(locality))}
        return F.when(at["registration"].isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))

    return bind(lines_of(text), found)


def after_label(lines: Column, label: str) -> Column:
    place = F.array_position(F.transform(lines, F.lower), label)
    return F.when(place > 0, F.get(lines, place.cast("int")))


def _first_match(lines: Column, pattern: str) -> Column:
    return F.get(F.filter(lines, lambda x: x.rlike(f"(?i){pattern}")), F.lit(0))


def _phrase(lines: Column, word: str, pattern: str, suffix: str) -> Column:
    """The line before a line that reads ``word``, with the suffix, or a phrase, whichever stands first."""
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    said = F.transform(places, lambda i: F.when((F.lower(F.get(lines, i)) == word) & (i > 0), F.concat(F.get(lines, i - 1), F.lit(suffix))).otherwise(F.nullif(F.regexp_extract(F.get(lines, i), f"(?i)({pattern})", 1), F.lit(""))))
    return F.get(F.array_compact(said), F.lit(0))


def parse_detail(text: Column) -> Column:
    """struct of the labelled values, report, warranty and return policy of a detail page; missing ones null."""

    def fields(lines: Column) -> Column:
        report = F.array_position(F.transform(lines, F.lower), V.REPORT_HEADING).cast("int")
        below = F.slice(lines, report + 1, F.lit(5))
        rest = F.slice(lines, F.greatest(report, F.lit(1)), F.size(lines))
        has = report > 0

        def score(label: str, pattern: str) -> Column:
            place = F.array_position(rest, label).cast("int")
            return F.when(has & (place > 0), _first_match(F.slice(rest, place + 1, F.lit(4)), pattern))

        scores = F.struct(*[F.struct(score(label, V.REPORT_SCORE).alias("score"), score(label, V.REPORT_GRADE).alias("grade")).alias(n) for label, n in SCORE_LABELS.items()])
        columns = {n: after_label(lines, label) for n, label in DETAIL_LABELS.items()}
        columns |= {
            "inspection_status": F.when(has, V.REPORT_STATUS), "inspection_summary": F.when(has, _first_match(below, V.REPORT_SUMMARY)), "quality_scores": scores, "service_due_text": _first_match(lines, V.SERVICE_DUE),
            "warranty_label": _phrase(lines, "warranty", V.WARRANTY_PHRASE, " warranty"), "return_policy_label": _phrase(lines, "money back", V.MONEY_BACK_PHRASE, " money back"),
        }
        return F.when(F.size(lines) > 0, F.struct(*[c.alias(n) for n, c in columns.items()]))

    return bind(lines_of(text), fields)


def detail_is_complete(detail: Column) -> Column:
    """A detail page counts as captured if it tells the number of owners."""
    return F.coalesce(detail["ownership"] != "", F.lit(False))

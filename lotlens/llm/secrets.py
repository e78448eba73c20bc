"""Secret scan behind a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is parsed into a Boolean trigram query that every match must satisfy
(alternatives become OR, sequences AND; trigrams are folded to lower case, which only widens a query).
The index holds postings (trigram, document) for the trigrams that the rules mention. Intersecting a
query's postings gives candidate documents, which are verified with the expression itself; a rule
without a mandatory trigram scans every text. Spans are code points, stop exclusive.

The expressions' matches are leftmost and do not overlap within a rule; matches that are too short are
dropped afterwards. Starts come from the lengths of the pieces between matches.

Edge cases: null text counts as empty; repeated rows are scanned once each; null ids join null-safely;
ties in start are ordered by rule; texts of any length are scanned whole, and their spans gathered in
stretches of ``STRETCH``, so that many spans in one text don't cost their square; an empty table gives an
empty result; extra columns are carried along, whatever their names, but for one named like the spans'
column, which :func:`scan` replaces.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import let, packed


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and how many characters a group (0: the match) must have."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16}[0-9a-f]*", 16),
)
#: Further kinds that a scan adds to the base ones.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36}[A-Za-z0-9]*"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10}[A-Za-z0-9-]*"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10}[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES
MOST_STRINGS = 64
STRETCH = 256
SPANS = "array<struct<start:int,order:int,stop:int,kind:string>>"

#: A query: None (all documents), a trigram, ("and", queries) or ("or", queries).
Query = object


def _all(queries: list) -> Query:
    queries = list(dict.fromkeys(q for q in queries if q is not None))
    return None if not queries else queries[0] if len(queries) == 1 else ("and", tuple(queries))


def _any(queries: list) -> Query:
    if None in queries:
        return None
    queries = list(dict.fromkeys(queries))
    return queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _of_string(text: str) -> Query:
    return _all([text[i : i + 3] for i in range(len(text) - 2)])


def _strings(op, arg) -> list[str] | None:
    """Every string that a node matches, if they are few; else None."""
    if op is sre.LITERAL:
        return [chr(arg).lower()]
    if op is sre.IN:
        if any(kind is not sre.LITERAL for kind, _ in arg) or len(arg) > 8:
            return None
        return sorted({chr(code).lower() for _, code in arg})
    if op is sre.SUBPATTERN:
        return _strings_of(arg[-1])
    if op is sre.BRANCH:
        parts = [_strings_of(x) for x in arg[1]]
        return None if None in parts else list(dict.fromkeys(s for p in parts for s in p))
    if op is sre.MAX_REPEAT and arg[1] <= 4:
        one = _strings_of(arg[2])
        return None if one is None else _few(list(dict.fromkeys(s for n in range(arg[0], arg[1] + 1) for s in _product([one] * n))))
    return None


def _few(strings: list[str] | None) -> list[str] | None:
    return strings if strings is not None and len(strings) <= MOST_STRINGS else None


def _product(parts: list[list[str]]) -> list[str]:
    out = [""]
    for p in parts:
        out = [a + b for a in out for b in p]
    return out


def _strings_of(nodes) -> list[str] | None:
    out = [""]
    for op, arg in nodes:
        one = _strings(op, arg)
        out = _few(None if one is None else _product([out, one]))
        if out is None:
            return None
    return out


def _query_of(nodes) -> Query:
    """AND over a sequence's stretches of known strings and over what lies between them."""
    found, run = [], [""]
    for op, arg in nodes:
        one = _strings(op, arg)
        longer = _few(_product([run, one])) if one is not None else None
        if longer is not None:
            run = longer
            continue
        found.append(_any([_of_string(s) for s in run]))
        run = one if one is not None else [""]
        if one is None and op is sre.SUBPATTERN:
            found.append(_query_of(arg[-1]))
        elif one is None and op is sre.BRANCH:
            found.append(_any([_query_of(x) for x in arg[1]]))
        elif one is None and op is sre.MAX_REPEAT and arg[0] >= 1:
            found.append(_query_of(arg[2]))
    return _all([*found, _any([_of_string(s) for s in run])])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression; None where no trigram is mandatory."""
    return _query_of(parser.parse(pattern))


def trigrams(query: Query) -> list[str]:
    if query is None:
        return []
    return [query] if isinstance(query, str) else list(dict.fromkeys(g for q in query[1] for g in trigrams(q)))


def _holds(query: Query, grams: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(grams, query)
    parts = [_holds(q, grams) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def postings(texts: DataFrame, grams: list[str], text_col: str, *keys: str) -> DataFrame:
    """The inverted index over ``grams``: a row (gram, keys) for each text (not null) that contains it."""
    folded = texts.select(*keys, F.lower(text_col).alias("folded"))
    held = F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(F.col("folded"), g))
    return folded.select(F.explode(held).alias("gram"), *keys)


def candidates(index: DataFrame, queries: dict[str, Query], *keys: str) -> DataFrame:
    """Intersect the postings: keys and ``kinds``, the rules whose query the document satisfies."""
    held = index.groupBy(*keys).agg(F.collect_set("gram").alias("grams"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("grams")), F.lit(kind)) for kind, q in queries.items()]))
    return held.select(*keys, kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,order,stop,kind>> of a rule's matches that are long enough."""
    pattern = F.lit(rule.pattern)

    def located(pieces: Column, found: Column, checked: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.char_length(F.get(pieces, i))
            stop = start + F.char_length(F.get(found, i))
            span = F.struct(start.alias("start"), F.lit(order).alias("order"), stop.alias("stop"), F.lit(rule.kind).alias("kind"))
            out = F.when(F.char_length(F.get(checked, i)) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
            return F.struct(stop.alias("at"), out.alias("out"))

        def stretch(acc: Column, k: Column) -> Column:
            places = F.sequence(k * STRETCH, F.least((k + 1) * STRETCH, F.size(found)) - 1)
            inner = F.aggregate(places, F.struct(acc["at"].alias("at"), F.array().cast(SPANS).alias("out")), step)
            return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
        last = F.floor((F.size(found) - 1) / F.lit(STRETCH)).cast("int")
        return F.flatten(F.aggregate(F.sequence(F.lit(0), last), zero, stretch)["out"])

    spans = let(
        F.split(text, rule.pattern, -1),
        lambda pieces: let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: let(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda checked: located(pieces, found, checked))),
    )
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(SPANS))


def _found(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """row (the document's columns), text (null: empty) and spans."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    grams = list(dict.fromkeys(g for q in indexed.values() for g in trigrams(q)))
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    keyed = packed(docs).select("row", F.unhex(F.md5(text)).alias("hash"))
    texts = keyed.select(F.col(f"row.`{id_col}`").alias("of_id"), F.col("hash").alias("of_hash"), text.alias("text"))
    some = candidates(postings(texts, grams, "text", "of_id", "of_hash"), indexed, "of_id", "of_hash").hint("shuffle_hash")
    joined = keyed.join(some, F.col(f"row.`{id_col}`").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left")
    parts = []
    for order, rule in enumerate(rules):
        spans = _spans(text, rule, order)
        parts.append(spans if queries[rule.kind] is None else F.when(F.array_contains("kinds", rule.kind), spans).otherwise(F.array().cast(SPANS)))
    return joined.select("row", text.alias("text"), F.array_sort(F.concat(*parts)).alias("spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` with ``spans_col``: array<struct<start,order,stop,kind>> in order of start, then of the rules."""
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() != spans_col.lower()]
    return _found(docs, rules, id_col, text_col).select(*kept, F.col("spans").alias(spans_col))


def listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; texts without one stay as they are.

    ``length_col`` names a column with the text's length, to be counted anew where the text has changed.
    """
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    clean = let(F.aggregate("spans", zero, step), lambda end: F.concat(F.array_join(end["out"], ""), F.substr(text, end["at"] + 1)))
    changed = F.size("spans") > 0
    found = _found(docs, rules, id_col, text_col).withColumn("clean", F.when(changed, clean))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns[text_col] = F.when(changed, F.col("clean")).otherwise(columns[text_col])
    if length_col:
        columns[length_col] = F.when(changed, F.char_length("clean")).otherwise(columns[length_col]).cast(docs.schema[length_col].dataType)
    return found.select(*[value.alias(name) for name, value in columns.items()])

"""Token counts by field or section: whole documents are encoded once and tokens attributed by offset.

A token's span in characters comes from the byte lengths of its id, because byte-level encoding is
lossless; a token belongs to the characters that its bytes touch. Token spans and section spans of a
document are both sorted, so their interval join is a binary search per token, in the task that
encoded the document: nothing is shuffled and no token becomes a row.

A token whose characters lie in several sections is given to one of them by ``rule``:
``first`` (the section of its first character), ``last`` (of its last one) or ``most`` (the one with
most of its characters, the earlier one in a tie). Characters outside every section count for none.

Sections default to lines with their newline; a column of ``array<struct<name,start,stop>>`` (code
points, stop exclusive, sorted, disjoint) may be named instead.

Edge cases: null text counts as empty and has one empty section with no tokens; repeated rows are counted
once each; null ids are carried; a null section list counts as no sections; a text of any length is
encoded whole; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import vocabulary, whole

BATCH_ROWS = 64
RULES = ("first", "last", "most")


def rank_table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def token_spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    stop = np.cumsum(sizes[ids])
    return char[stop - sizes[ids]], char[stop - 1]


def attribute(first: np.ndarray, last: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section under ``rule``, and how many of them also touch characters outside it."""
    n = len(start)
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not len(first) or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    lo = np.searchsorted(stop, first, "right")  # the first section that ends after the token's first character
    hi = np.searchsorted(start, last, "right") - 1  # the last one that begins by its last character
    if rule == "first":
        owner = np.where((lo < n) & (start[np.minimum(lo, n - 1)] <= first), lo, -1)
    elif rule == "last":
        owner = np.where((hi >= 0) & (stop[np.maximum(hi, 0)] > last), hi, -1)
    else:
        owner, best = np.full(len(first), -1), np.zeros(len(first), np.int64)
        for step in range(int(max(0, (hi - lo).max(initial=0))) + 1):
            at = np.minimum(lo + step, n - 1)
            width = np.where(lo + step <= hi, np.minimum(last + 1, stop[at]) - np.maximum(first, start[at]), 0)
            owner, best = np.where(width > best, at, owner), np.maximum(width, best)
    own = owner[owner >= 0]
    crossing = (first < start[owner]) | (last >= stop[owner])
    return np.bincount(own, minlength=n), np.bincount(owner[(owner >= 0) & crossing], minlength=n)


def line_sections(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    sizes = np.array([len(x) + 1 for x in text.split("\n")], np.int64)
    stop = np.cumsum(sizes)
    start = stop - sizes
    stop[-1] -= 1
    return [f"line{i}" for i in range(len(sizes))], start, stop


def count_tokens(docs: DataFrame, rule: str = "first", sections_col: str | None = None, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and section: doc_id, section, name, start, stop, n_tokens, n_crossing, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = ranks_path or vocabulary("byte_bpe_50k.tiktoken")
    fields = [("section", T.IntegerType()), ("name", T.StringType())] + [(n, T.LongType()) for n in ("start", "stop", "n_tokens", "n_crossing", "doc_tokens")]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(n, t) for n, t in fields]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        ranks = rank_table(path)
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        sizes[list(ranks.values())] = [len(t) for t in ranks]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                given = part["sections"].to_pylist() if sections_col else [None] * part.num_rows
                rows, columns = [], [[] for _ in fields]
                for r, (text, sections) in enumerate(zip(part["text"].to_pylist(), given, strict=True)):
                    ids = np.array(encoding.encode_ordinary(text), np.int64)
                    if sections_col:
                        sections = sections or []
                        names, start, stop = [s["name"] for s in sections], np.array([s["start"] for s in sections], np.int64), np.array([s["stop"] for s in sections], np.int64)
                    else:
                        names, start, stop = line_sections(text)
                    first, last = token_spans(text, ids, sizes)
                    own, crossing = attribute(first, last, start, stop, rule)
                    n = len(names)
                    rows += [r] * n
                    for column, values in zip(columns, (range(n), names, start, stop, own, crossing, [len(ids)] * n), strict=True):
                        column.extend(values)
                kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], schema.names)

    columns = [F.col(id_col).alias("doc_id"), whole(text_col).alias("text")] + ([F.col(sections_col).alias("sections")] if sections_col else [])
    return docs.select(*columns).mapInArrow(count, schema)

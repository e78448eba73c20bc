"""Toxicity scores from a logistic model that identity swaps must not move.

Features are the presence of hashed words and word beginnings (four to six letters, for inflected
stems). The model is fitted on at most ``MAX_ROWS`` labelled rows, the ones with the smallest id hash,
whatever the table's size; only their feature lists reach the driver. Each labelled text that holds
identity terms (groups named outright, and pronouns by gender) is fitted together with counterfactuals in
which every such term is swapped for another of its group; ``penalty`` times the squared change of the
logit is added to the loss, so that the model cannot learn a neutral mention as a sign of toxicity. The
terms' own features always stay in the model, so that the penalty has something to act on. Scoring is
row by row with a fixed-size weight table: no shuffle of the texts.

Labels, language, source and id are never features. Rows whose crc32(id as text) mod 3 is 1 are held out.

Edge cases: null and empty texts score the prior; null labels and ids are not learnt from; a null id is
not held out; repeated label rows count as often as they occur (within ``MAX_ROWS``), and of documents
that repeat an id the text with the largest hash is learnt from; without both classes among the labels
every score is 0; texts of any length are scored whole; an empty table gives an empty result; extra
columns are ignored by :func:`score` and carried along, whatever their names, by :func:`drop_toxic`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import whole

BITS = 20
MAX_ROWS = 8_000
THRESHOLD = 0.7
BATCH_ROWS = 256
PREFIXES = (4, 5, 6)
#: Neutral group mentions by language; a term is only swapped within its tuple.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian"), ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "atheist"), ("immigrants", "refugees", "natives"), ("old", "young"), ("blind", "deaf", "disabled"),
    ("he", "she"), ("him", "her"), ("his", "hers"), ("himself", "herself"),
    ("er", "sie"), ("ihn", "ihr"), ("il", "elle"), ("ils", "elles"), ("él", "ella"), ("ellos", "ellas"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, 2^BITS
    bias: float


def words_of(text: str) -> list[str]:
    import regex

    return regex.findall(r"[^\W\d_]+", text.lower())


class Hasher:
    """Feature numbers of words, remembered for a bounded number of words."""

    def __init__(self, most: int = 60_000):
        self.known: dict[str, tuple[int, ...]] = {}
        self.most = most

    def word(self, w: str) -> tuple[int, ...]:
        found = self.known.get(w)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            names = [f"w:{w}", *[f"p{n}:{w[:n]}" for n in PREFIXES if len(w) >= n]]
            found = self.known[w] = tuple(zlib.crc32(n.encode()) >> (32 - BITS) for n in names)
        return found

    def text(self, words: list[str]) -> np.ndarray:
        return np.array(sorted({f for w in set(words) for f in self.word(w)}), np.int64)


def swapped(words: list[str], terms=IDENTITY_TERMS) -> list[list[str]]:
    """The counterfactuals: in the k-th one each identity term becomes the k-th next of its group."""
    place = {w: (group, i) for group in terms for i, w in enumerate(group)}
    hit = [(at, *place[w]) for at, w in enumerate(words) if w in place]
    out = []
    for k in range(1, max((len(group) for _, group, _ in hit), default=1)):
        other = list(words)
        for at, group, i in hit:
            other[at] = group[(i + k) % len(group)]
        if other != words:
            out.append(other)
    return out


def difference(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``other`` has and ``own`` lacks, and the other way round."""
    return np.setdiff1d(other, own, True), np.setdiff1d(own, other, True)


def fit(features: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], penalty: float = 1.0, l2: float = 1e-4, steps: int = 300, rate: float = 0.3, least_rows: int = 3, least_chi2: float = 8.0, always: np.ndarray | None = None) -> Model:
    """Logistic regression by Adagrad on the mean loss, ridge and counterfactual penalty.

    ``swaps`` holds what each counterfactual adds to its text's features and what it takes away; all others
    cancel out in the change of the logit. Features in fewer than ``least_rows`` rows, or whose
    chi-square against the label is under ``least_chi2``, are left out: most words say nothing. Features
    in ``always`` stay.
    """
    size = 1 << BITS
    weights = np.zeros(size, np.float32)
    n = len(labels)
    if n == 0 or labels.min() == labels.max():
        return Model(weights, -np.inf)
    flat, row = np.concatenate(features).astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in features])
    seen, in_toxic = np.bincount(flat, minlength=size), np.bincount(flat[labels[row] == 1], minlength=size)
    base = labels.mean()
    chi2 = (in_toxic - seen * base) ** 2 / np.maximum(seen * base * (1 - base) * (1 - seen / (n + 1)), 1e-9)
    telling = (seen >= least_rows) & (chi2 >= least_chi2)
    if always is not None and len(swaps):
        telling[always] = True
    used = np.flatnonzero(telling)
    at = np.full(size, -1)
    at[used] = np.arange(len(used))
    row, flat = row[at[flat] >= 0], at[flat[at[flat] >= 0]]
    moves = np.concatenate([x for pair in swaps for x in pair]).astype(np.int64) if swaps else np.zeros(0, np.int64)
    sizes = np.array([len(x) for pair in swaps for x in pair], np.int64)
    s_row, sign = np.repeat(np.arange(len(sizes)) // 2, sizes), np.repeat(np.tile([1.0, -1.0], len(swaps)), sizes)
    kept = at[moves] >= 0
    s_row, sign, s_flat = s_row[kept], sign[kept], at[moves[kept]]
    share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))  # both classes weigh the same
    w, b = np.zeros(len(used)), 0.0
    gw, gb = np.full(len(used), 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(row, w[flat], n) + b
        err = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
        grad = l2 * w + np.bincount(flat, err[row], len(used))
        if len(swaps):
            change = np.bincount(s_row, sign * w[s_flat], len(swaps)) * (2 * penalty / len(swaps))
            grad = grad + np.bincount(s_flat, sign * change[s_row], len(used))
        step_b = err.sum()
        gw += grad**2
        gb += step_b**2
        w -= rate * grad / np.sqrt(gw)
        b -= rate * step_b / np.sqrt(gb)
    weights[used] = w
    return Model(weights, float(b))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", terms=IDENTITY_TERMS) -> tuple[list[np.ndarray], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Features, labels and swaps of a bounded sample of the labelled rows that are not held out."""
    marked = labels.filter(~held_out(id_col)).filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    order = F.xxhash64(id_col)
    total = marked.count()
    if total > max_rows:  # a cut by hash leaves little more than the bound to sort
        marked = marked.filter(F.pmod(order, F.lit(1 << 20)) < F.lit(min(1 << 20, 1 + int((1 << 20) * 1.2 * max_rows / total))))
    chosen = marked.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), order.alias("h")).orderBy("h", "id", "y").limit(max_rows).toArrow()
    if not chosen.num_rows:
        return [], np.zeros(0, np.int64), []
    # max_rows numbers at most
    wanted = docs.sparkSession.createDataFrame(pa.table({"id": chosen["id"].unique()}), T.StructType([T.StructField("id", docs.schema[id_col].dataType)]))
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).join(F.broadcast(wanted), "id")
    sample = texts.groupBy("id").agg(F.max_by("text", F.xxhash64("text")).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                words = [words_of(t) for t in part["text"].to_pylist()]
                own = [hasher.text(w).astype(np.int32) for w in words]
                moves = [[x.tolist() for o in swapped(w, terms) for x in difference(f, hasher.text(o).astype(np.int32))] for w, f in zip(words, own, strict=True)]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(own, pa.list_(pa.int32())), pa.array(moves, pa.list_(pa.list_(pa.int32())))], ["id", "own", "moves"])

    rows = sample.mapInArrow(extract, T.StructType([sample.schema["id"], T.StructField("own", T.ArrayType(T.IntegerType())), T.StructField("moves", T.ArrayType(T.ArrayType(T.IntegerType())))])).toArrow()
    place = {k: r for r, k in enumerate(rows["id"].to_pylist())}
    own, moves = rows["own"].to_numpy(), rows["moves"].to_pylist()
    learnt = [(place[k], y) for k, y in zip(chosen["id"].to_pylist(), chosen["y"].to_pylist(), strict=True) if k in place]
    swaps = [(np.array(more, np.int64), np.array(less, np.int64)) for r, _ in learnt for more, less in zip(moves[r][::2], moves[r][1::2])]
    return [own[r] for r, _ in learnt], np.array([y for _, y in learnt], np.int64), swaps


def term_features(terms=IDENTITY_TERMS) -> np.ndarray:
    return Hasher().text([w for group in terms for w in group])


def train(docs: DataFrame, labels: DataFrame, penalty: float = 1.0, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", terms=IDENTITY_TERMS) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    return fit(*examples(docs, labels, max_rows, id_col, text_col, label_col, terms), penalty, always=term_features(terms))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, hasher = shared.value.weights, shared.value.bias, Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                z = np.array([float(weights[hasher.text(words_of(t))].sum(dtype=np.float64)) + bias for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))) if bias > -np.inf else np.zeros(len(z)))], schema.names)

    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), whole(text_col).alias("text")).mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the model rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias, hasher = shared.value.weights, shared.value.bias, Hasher()
        cut = np.log(threshold / (1 - threshold))
        for texts in batches:
            yield texts.map(lambda t: bool(weights[hasher.text(words_of(t))].sum(dtype=np.float64) + bias >= cut)).astype(bool)

    return docs.filter(~rejected(whole(text_col)))

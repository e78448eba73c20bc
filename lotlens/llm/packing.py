"""Concatenate-and-cut packing with two-pass prefix sums.

Pass one encodes each partition once, appends the end token to every document and stores the ids as
16-bit numbers with the document's offset inside its partition (a table in the shared scratch folder).
The partitions' token totals, one row each, become global offsets by a running sum. Pass two adds a
document's two offsets and cuts its ids at multiples of the window; every piece is a boundary record.
No text and no ids are shuffled, so a source or document of any size changes nothing.

Chunks and words are encoded once per task and remembered (``CACHE_WORDS`` and twice as many at most). This gives the ids of whole-text encoding, because the tokenizer
normalises the text first and then never merges across its pre-tokens.

All windows are full but the last one, which is padded to the window unless it is a power of two long.

Edge cases: null text counts as empty and yields just the end token; repeated rows are packed once each;
null ids are carried; a text of any length is encoded whole, by itself if it exceeds a batch of
``BATCH_BYTES``; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, compress
from operator import add, not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import vocabulary, whole, written

WINDOW = 2048
END_ID = 1
CACHE_WORDS = 300_000
BATCH_BYTES = 8_000_000
MARKS = frozenset(".,;:!?|")


class WordEncoder:
    """Ids of whole texts from a word-level tokenizer file, by bounded caches.

    No token spans white space, so a text's ids are those of its blank-separated chunks in a row. Chunks
    seen before are looked up; others are split into words by the tokenizer's pattern, and words not seen
    before are encoded together as one text, in which tokens that end a word mark where each one stops.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        # for words that are normalised and split already
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.words = regex.compile(model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        # Python splits at these, the tokenizer does not: such texts are encoded by it as they are
        self.blanks = re.compile(r"[^\S\x00-\x7f]").sub
        self.separators = re.compile("[\x1c-\x1f]").search
        suffix = model["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(model["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in model["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.chunks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _learn_words(self, unseen: list[str]) -> None:
        for start in range(0, len(unseen), 20_000):
            part = unseen[start : start + 20_000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u2")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # some word has an end mark within: encode each by itself
                for w, e in zip(part, self.plain.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self.known[w] = np.array(e.ids, "<u2").tobytes()
                continue
            raw, at = ids.tobytes(), 0
            for w, stop in zip(part, (stops * 2).tolist(), strict=True):
                self.known[w] = raw[at:stop]
                at = stop

    def _learn_chunks(self, unseen: list[str]) -> None:
        """Ids of chunks: of letters, of letters before a mark, and of any others by the pattern's words.

        The first two kinds are nearly all of them; they take no list and no loop of Python's for each chunk.
        """
        letters = list(map(str.isalpha, unseen))
        single, others = list(compress(unseen, letters)), list(compress(unseen, map(not_, letters)))
        heads = [c[:-1] for c in others]
        marked = [h and c[-1] in MARKS for c, h in zip(others, map(str.isalpha, heads), strict=True)]
        bases, double = list(compress(heads, marked)), list(compress(others, marked))
        marks = [c[-1] for c in double]
        split = {c: self.words(c) for c in compress(others, map(not_, marked))}
        self._learn_words(list({*single, *bases, *marks, *chain.from_iterable(split.values())}.difference(self.known)))
        known = self.known.__getitem__
        self.chunks.update(zip(single, map(known, single), strict=True))
        self.chunks.update(zip(double, map(add, map(known, bases), map(known, marks)), strict=True))
        for c, ws in split.items():
            self.chunks[c] = b"".join(map(known, ws))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = [i for i, t in enumerate(texts) if self.separators(t)]
        out = self._encode([t if i not in odd else "" for i, t in enumerate(texts)] if odd else texts)
        if odd:
            from tokenizers import Tokenizer

            whole_text = Tokenizer.from_file(self.path)
            whole_text.encode_special_tokens = True
            for i in odd:
                out[i] = np.array(whole_text.encode(texts[i], add_special_tokens=False).ids, "<u2")
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        # the tokenizer lower-cases letter by letter, so a final capital sigma is no exception to it
        lower = [t.lower() if t.isascii() else self.blanks(" ", unicodedata.normalize("NFC", t).replace("\u03a3", "\u03c3").lower()) for t in texts]
        chunks = pc.ascii_split_whitespace(pa.array(lower, pa.large_string()))
        coded = chunks.flatten().dictionary_encode()
        distinct, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.chunks) > self.cache_words:
            self.chunks.clear()
        if len(self.known) > 2 * self.cache_words:
            self.known.clear()
        self._learn_chunks(list(set(distinct).difference(self.chunks)))
        raw = list(map(self.chunks.__getitem__, distinct))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
        table, first = np.frombuffer(b"".join(raw), "<u2"), np.cumsum(sizes) - sizes
        n = sizes[codes]
        stops = np.cumsum(n)
        # a batch of BATCH_BYTES, or one text, has fewer than 2^31 tokens, as Arrow bounds a text; 32 bits halve the memory of the gather
        ids = table[np.arange(stops[-1] if len(n) else 0, dtype=np.int32) + np.repeat((first[codes] - (stops - n)).astype(np.int32), n)]
        edges = np.concatenate([[0], stops])[chunks.offsets.to_numpy()]
        return [ids[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES of a column, a row at least."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pc.binary_length(batch[column]).to_pylist()):
            if size and size + n > BATCH_BYTES:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one: doc_id, part, before (tokens before it in its partition), tokens, ids (16-bit, binary)."""
    path = tokenizer_path or vocabulary("word_bpe_49k.json")
    schema = T.StructType(
        [docs.schema[id_col].__class__("doc_id", docs.schema[id_col].dataType), *[T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("before", T.LongType()), ("tokens", T.LongType()), ("ids", T.BinaryType()))]]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        part, before, encoder = TaskContext.get().partitionId(), 0, WordEncoder(path)
        for batch in _slices(batches, "text"):
            end = np.array([END_ID], "<u2")
            ids = [np.concatenate([x, end]) for x in encoder.encode(batch["text"].to_pylist())]
            sizes = np.array([len(x) for x in ids], np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(sizes), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["doc_id", "part", "before", "tokens", "ids"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).mapInArrow(encode, schema)


def pack(docs: DataFrame, window: int = WINDOW, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids, ids_crc32.

    ``ids`` are 16-bit numbers; the unsigned CRC-32 is that of the ids as little-endian 32-bit ones.
    """
    encoded = written(encode_documents(docs, tokenizer_path, id_col, text_col), "pack")
    totals = encoded.groupBy("part").agg(F.max(F.col("before") + F.col("tokens")).alias("total")).collect()  # a row for each partition
    first, offsets = 0, {}
    for row in sorted(totals, key=lambda r: r["part"]):
        offsets[row["part"]] = first
        first += row["total"]
    base = np.zeros(max(offsets, default=0) + 1, np.int64)
    base[list(offsets)] = list(offsets.values())
    schema = T.StructType(
        [encoded.schema["doc_id"], *[T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType()), ("ids_crc32", T.LongType()))]]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "ids"):
            begin = base[batch["part"].to_numpy()] + batch["before"].to_numpy()
            sizes = batch["tokens"].to_numpy()
            pieces = (begin + sizes - 1) // window - begin // window + 1
            row = np.repeat(np.arange(len(sizes)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = begin[row] // window + nth
            lo = np.maximum(begin[row], sequence * window)
            hi = np.minimum((begin + sizes)[row], (sequence + 1) * window)
            start, length = lo - begin[row], hi - lo
            ids = batch["ids"].to_pylist()
            cuts = [ids[r][2 * s : 2 * (s + n)] for r, s, n in zip(row, start, length, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(row)), *map(pa.array, (start, length, sizes[row], sequence, lo - sequence * window)), pa.array(cuts, pa.binary()), pa.array([zlib.crc32(np.frombuffer(c, "<u2").astype("<u4")) for c in cuts], pa.int64())],
                schema.names,
            )

    return encoded.mapInArrow(cut, schema)

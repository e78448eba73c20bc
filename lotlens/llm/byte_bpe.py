"""Byte-level BPE by a fold over ranked merges in Spark's higher-order functions.

A word is a string with one character for each token so far, at first one for each byte. A literal
rank map, dealt into buckets because Spark searches a map from its start, gives for two neighbouring
tokens the merged one. The fold merges the lowest-ranked pair, the leftmost of equals, until none is
left. Token i is the character i + 256, which keeps the order of ranks under comparison and stays below
the surrogates.

Tasks split their documents into words, number the distinct words of a block of documents (about
``BLOCK_CHARS`` characters, a document at least) and write each document as word numbers. The block's
distinct words are folded once and the numbers replaced by their ids. Everything is narrow: nothing is
shuffled, broadcast or sent to the driver, and a lost executor costs its own tasks only. The blocks'
distinct words grow with the texts, so the work stays in proportion to the input.

All occurrences of the lowest pair are merged in one step, which saves steps for words of many equal
letters. That equals one at a time from the left unless a merge can lead to a pair of lower rank or an
overlapping pair gives the same token; :func:`careful` lists the merged tokens for which the rank table
allows that, and those are merged one at a time. Words of more than ``LONGEST_WHOLE`` characters are cut
between bytes that stand side by side in no token, which no merge can cross.

Decoding concatenates the binary pieces of the ids.

Edge cases: null text counts as empty and has no ids; repeated rows are encoded once each; null ids are
carried; texts and words of any length are encoded whole (a block holds the numbers of one text at
least, four bytes a word); an empty table gives an empty result; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import let, vocabulary, whole
from .token_counts import rank_table

BUCKETS = 1 << 15
SHIFT = 256
DONE = "\x01"  # before the tokens of a word that has no pair left
BLOCK_CHARS = 32_000_000
LONGEST_WHOLE = 64
OUT_WORDS = 200_000  # words whose ids are put together at a time


def merges(ranks: dict[bytes, int]) -> dict[str, str]:
    """For each two tokens whose bytes together are a token: their characters to the merged one's."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                out[chr(left + SHIFT) + chr(right + SHIFT)] = chr(rank + SHIFT)
    return out


def careful(pairs: dict[str, str]) -> set[str]:
    """Merged tokens whose pairs may not be merged all at once.

    Either the token belongs to a pair of lower rank, or two of its own pairs can share a token.
    """
    out = {part for pair, merged in pairs.items() for part in pair if part > merged}
    splits: dict[str, list[str]] = {}
    for pair, merged in pairs.items():
        splits.setdefault(merged, []).append(pair)
    for merged, own in splits.items():
        if len(own) > 1 and {p[0] for p in own} & {p[1] for p in own}:
            out.add(merged)
    return out


def _bucket(pair: str) -> int:
    """The bucket of a pair, as ``xxhash64(pair) & (BUCKETS - 1)`` gives it in Spark."""
    return xxhash.xxh64_intdigest(pair.encode(), seed=42) % BUCKETS


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The merge table as one constant: buckets of maps from a pair to the merged character, 1 (careful) or 0, and the pair."""
    pairs = merges(ranks)
    one_by_one = careful(pairs)
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for pair, merged in pairs.items():
        buckets[_bucket(pair)][pair] = merged + ("1" if merged in one_by_one else "0") + pair
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,string>>")


def fold_word(word: Column, ranks: dict[bytes, int], table: Column | None = None) -> Column:
    """The token characters of a word (any string) under ``ranks``."""
    table = rank_literal(ranks) if table is None else table
    single = "".join(chr(ranks[bytes([b])] + SHIFT) for b in range(256))
    start = F.translate(F.decode(word.cast("binary"), "ISO-8859-1"), "".join(map(chr, range(256))), single)

    def merged(pair: Column) -> Column:
        return F.get(table, F.xxhash64(pair).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))[pair]

    def step(tokens: Column, _: Column) -> Column:
        places = F.sequence(F.lit(1), F.char_length(tokens) - 1)

        def after(found: Column, best: Column) -> Column:
            token = F.substring(best, 1, 1)
            # built-in array_position is slow where it finds something, and only few tokens need the place
            first = F.get(F.filter(places, lambda i: F.startswith(F.get(found, i - 1), token)), F.lit(0))
            one, every = F.overlay(tokens, token, first, F.lit(2)), F.replace(tokens, F.substring(best, 3, 2), token)
            return F.when(best.isNull(), F.concat(F.lit(DONE), tokens)).when(F.substring(best, 2, 1) == "1", one).otherwise(every)

        found = F.transform(places, lambda i: merged(F.substring(tokens, i, F.lit(2))))
        ended = F.startswith(tokens, F.lit(DONE)) | (F.char_length(tokens) < 2)
        return F.when(ended, tokens).otherwise(let(found, lambda f: let(F.array_min(f), lambda best: after(f, best))))

    folded = F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), start, step)
    return F.replace(folded, F.lit(DONE), F.lit(""))


def crossings(ranks: dict[bytes, int]) -> np.ndarray:
    """For first * 256 + second byte: whether a token has them side by side."""
    out = np.zeros(1 << 16, bool)
    for token in ranks:
        raw = np.frombuffer(token, np.uint8).astype(np.int64)
        out[raw[:-1] * 256 + raw[1:]] = True
    return out


def pieces(word: str, crossed: np.ndarray) -> list[str]:
    """The word, cut between characters whose neighbouring bytes are side by side in no token."""
    raw = np.frombuffer(word.encode(), np.uint8).astype(np.int64)
    cut = ~crossed[raw[:-1] * 256 + raw[1:]] & (raw[1:] & 0xC0 != 0x80)
    ends = [*(np.flatnonzero(cut) + 1).tolist(), len(raw)]
    data = raw.astype(np.uint8).tobytes()
    return [data[i:j].decode() for i, j in zip([0, *ends], ends)]


class Numbers(dict):
    """Words to numbers in order of appearance; words of more than ``LONGEST_WHOLE`` characters have none."""

    def __missing__(self, word: str) -> int:
        if len(word) > LONGEST_WHOLE:
            return -1
        self[word] = out = len(self)
        return out


#: The public split pattern for text of Latin-1 characters alone, with letters, numbers and white space spelt out.
_LETTERS, _NUMBERS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]++| ?[{_NUMBERS}]++| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]++|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"


def splitter(pattern: str | None):
    """The function from a text to its words; the public pattern is matched twice as fast in Latin-1 text."""
    import regex

    if pattern is not None:
        return regex.compile(pattern).findall
    import public_tokenizers

    latin, full = re.compile(LATIN).findall, regex.compile(public_tokenizers.PATTERN).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return latin(text)

    return split


def _bytes_of(numbers: np.ndarray) -> pa.Array:
    """One binary value that is the array's own memory."""
    ends = pa.py_buffer(np.array([0, numbers.nbytes], np.int32))
    return pa.Array.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(numbers)])


def _numbered(pattern: str | None, crossed: np.ndarray, schema: T.StructType, block_chars: int):
    """Batches of documents to a row for each block: ids of documents, word numbers and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter(pattern)
        words, held, codes, size = Numbers(), [], [], 0

        def block() -> pa.RecordBatch:
            ids = pa.concat_arrays(held)
            stops = np.cumsum([0, *map(len, codes)], dtype=np.int64)
            row = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            flat = np.concatenate(codes)
            codes.clear()
            row += [_bytes_of(stops), _bytes_of(flat), pa.array([list(words)], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(row, schema.names)

        for batch in batches:
            begin = 0
            for i, text in enumerate(batch["text"]):
                text = text.as_py()
                found = find(text)
                row = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                if len(row) and row.min() < 0:
                    parts = [x for w in found for x in (pieces(w, crossed) if len(w) > LONGEST_WHOLE else (w,))]
                    row = np.array([words.setdefault(w, len(words)) for w in parts], np.int32)
                codes.append(row)
                size += len(text)
                if size >= block_chars:
                    held.append(batch["doc_id"].slice(begin, i + 1 - begin))
                    yield block()
                    words, held, codes, size, begin = Numbers(), [], [], 0, i + 1
            if begin < batch.num_rows:
                held.append(batch["doc_id"].slice(begin))
        if codes:
            yield block()

    return run


def _opened(row: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids of documents, stops and codes of their words, all words' ids in a row, and how many each word has."""
    sizes = pc.utf8_length(row["tokens"].flatten()).to_numpy().astype(np.int64)
    flat = np.frombuffer(pc.binary_join(row["tokens"], "")[0].as_py().encode("utf-16-le"), "<u2").astype(np.int32) - SHIFT
    return row["ids"].flatten(), np.frombuffer(row["stops"][0].as_buffer(), np.int64), np.frombuffer(row["codes"][0].as_buffer(), np.int32), flat, sizes


def _spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block, words folded, to a row for each document with its ids."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids, stops, codes, flat, sizes = _opened(batch.slice(r, 1))
            first, at = np.cumsum(sizes) - sizes, 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(stops, stops[at] + OUT_WORDS, "right")) - 1)
                part = codes[stops[at] : stops[to]]
                n = sizes[part]
                ends = np.cumsum(n)
                values = flat[np.arange(ends[-1] if len(n) else 0) + np.repeat(first[part] - (ends - n), n)]
                edges = np.concatenate([[0], ends])[stops[at : to + 1] - stops[at]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), pa.ListArray.from_arrays(pa.array(edges), pa.array(values))], ["doc_id", "ids"])
                at = to


def _folded(docs: DataFrame, ranks: dict[bytes, int], pattern: str | None, block_chars: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each block of documents: ids, stops, codes and the tokens of its distinct words."""
    numbered = T.StructType(
        [T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("stops", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("words", T.ArrayType(T.StringType()))]
    )
    blocks = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).mapInArrow(_numbered(pattern, crossings(ranks), numbered, block_chars), numbered)
    table = rank_literal(ranks)
    return blocks.select("ids", "stops", "codes", F.transform("words", lambda w: fold_word(w, ranks, table)).alias("tokens"))


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int), the ids of the whole text."""
    ranks = rank_table(ranks_path or vocabulary("byte_bpe_multi_50k.tiktoken"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _folded(docs, ranks, pattern, block_chars, id_col, text_col).mapInArrow(_spliced, schema)


def piece_table(path: str) -> list[bytes]:
    """The bytes of each id; ids without a token have none."""
    ranks = rank_table(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return pieces


def decode(coded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and raw, the bytes of each row's ids (null: none): the ids' binary pieces, concatenated."""
    path = ranks_path or vocabulary("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(path).__getitem__
        for batch in batches:
            raw = [b"".join(map(pieces, ids or ())) for ids in (x.as_py() for x in batch["ids"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return coded.select("doc_id", "ids").mapInArrow(run, T.StructType([coded.schema["doc_id"], T.StructField("raw", T.BinaryType())]))


def _per_word(flat: np.ndarray, sizes: np.ndarray, glue: bytes, table: list[bytes]) -> list[bytes]:
    """For each word the bytes that ``table`` has for its ids, joined."""
    out, ends = [], np.cumsum(sizes)
    for k in range(0, len(sizes), 20_000):
        stop = ends[k : k + 20_000] - (ends[k] - sizes[k])
        tokens, stop = flat[ends[k] - sizes[k] :][: stop[-1]].tolist(), stop.tolist()
        named = [table[t] for t in tokens]
        out += [glue.join(named[i:j]) for i, j in zip([0, *stop], stop)]
    return out


def digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document's ids and of what they decode to.

    Ids are written out and decoded once for each distinct word of a block; a document's text of ids and its
    bytes are its words' ones, concatenated.
    """
    path = ranks_path or vocabulary("byte_bpe_multi_50k.tiktoken")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(path)
        decimals = [str(i).encode() for i in range(len(pieces))]
        for batch in batches:
            for r in range(batch.num_rows):
                ids, stops, codes, flat, sizes = _opened(batch.slice(r, 1))
                rows = list(zip(stops[:-1].tolist(), stops[1:].tolist()))
                counts = pa.array([int(sizes[codes[i:j]].sum()) for i, j in rows], pa.int64())
                hashed = []
                for glue, table in ((b",", decimals), (b"", pieces)):  # one after the other, to hold one list of words' bytes at a time
                    word = _per_word(flat, sizes, glue, table).__getitem__
                    hashed.append(pa.array([sha256(glue.join(map(word, codes[i:j].tolist()))).hexdigest() for i, j in rows], pa.string()))
                yield pa.RecordBatch.from_arrays([ids, counts, *hashed], names)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _folded(docs, rank_table(path), None, BLOCK_CHARS, "doc_id", "text").mapInArrow(run, schema)

"""Operators that treat each document by itself, against brute force and the public libraries."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest

from lotlens.llm import byte_bpe, media, packing, queries, secrets, token_counts
from lotlens.llm.base import vocabulary

from .corpus import TEXTS, same, table

SMALL = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def test_media(spark):
    def brute(i, t):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        return i, len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:])

    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]
    same(media.digests(table(spark)), [brute(*x) for x in TEXTS], columns)
    same(queries.op1_media(spark, SMALL), [brute(*x) for x in texts(spark)], columns)
    rows = media.digests(table(spark)).collect()
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (1, 2)}) == 1
    assert all(len(r.feature) == 16 and r.media_bytes > 60 for r in rows)
    assert media.digests(table(spark, [])).count() == 0


def test_png_filters_and_checksums():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, 64), np.uint8)
    lines = []
    for y, row in enumerate(image):
        kind, up = y % 5, image[y - 1] if y else np.zeros(64, np.uint8)
        out = [kind]
        for x in range(64):
            a, b, c = int(row[x - 1]) if x else 0, int(up[x]), int(up[x - 1]) if x else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((int(row[x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        lines.append(out)
    assert (media.unfilter(np.array(lines, np.uint8)) == image).all()
    png = media.encode_png(image.tobytes())
    assert (media.decode_png(png) == image).all()
    for at in (20, 60, len(png) - 3):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(png[:-12])
    near, far = image.copy(), rng.integers(0, 256, (9, 64), np.uint8)
    near[0, 0] ^= 1
    bits = lambda a, b: bin(int.from_bytes(media.cosine_hash(a)) ^ int.from_bytes(media.cosine_hash(b))).count("1")
    assert bits(image, near) <= 4 < bits(image, far)


def test_token_counts(spark):
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_counts.rank_table(vocabulary("byte_bpe_50k.tiktoken")), special_tokens={})

    def brute(t, rule):
        t = t or ""
        lines, counts, line_of = t.split("\n"), [0] * len(t.split("\n")), []
        for k, x in enumerate(lines):
            line_of += [k] * (len(x) + (k < len(lines) - 1))
        raw_char = [k for k, ch in enumerate(t) for _ in ch.encode()]
        at = 0
        for token in encoding.encode_ordinary(t):
            n = len(encoding.decode_single_token_bytes(token))
            chars = [line_of[c] for c in dict.fromkeys(raw_char[at : at + n])]
            at += n
            counts[chars[0] if rule == "first" else chars[-1] if rule == "last" else max(sorted(set(chars)), key=chars.count)] += 1
        return counts

    for rule in token_counts.RULES:
        wanted = [(i, k, n) for i, t in TEXTS for k, n in enumerate(brute(t, rule))]
        same(token_counts.count_tokens(table(spark), rule), wanted, ["doc_id", "section", "n_tokens"])
    same(queries.op2_token_counts(spark, SMALL), [(i, k, n) for i, t in texts(spark) for k, n in enumerate(brute(t, "first"))], ["doc_id", "section", "n_tokens"])
    assert token_counts.count_tokens(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(table(spark), "half")


def brute_secrets(t):
    t = t or ""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found)


def test_secrets(spark):
    def brute(i, t):
        found = brute_secrets(t)
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
        return i, *[sum(f[3] == k for f in found) for k in ("assign", "access", "hex")], sha(listed)

    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    small = queries.op3_secrets(spark, "/root/testdata/sf0.01").collect()
    wanted = {r.doc_id: brute(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert {r.doc_id: tuple(r[c] for c in columns) for r in small} == wanted and any(sum(w[1:4]) for w in wanted.values())
    more = [*TEXTS, (30, "é🙂 api_key='0123456789abcdef0123' APIKEY:abcdefabcdefabcdef"), (31, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20), (32, "AKIA" * 6 + " token=" * 3 + "x" * 12)]
    found = secrets.scan(table(spark, more))
    same(found.selectExpr("doc_id", "array_join(transform(filter(spans, s -> s.order < 3), s -> concat_ws(':', s.kind, string(s.start), string(s.stop))), ',') AS got"), [(i, ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute_secrets(t))) for i, t in more], ["doc_id", "got"])
    clean = {r.doc_id: r.text for r in secrets.redact(table(spark, more)).collect()}
    assert clean[31] == "[private_key] [forge_token]" and clean[1] == TEXTS[0][1] and clean[3] is None
    assert "abcdefghijkl" not in clean[12] and clean[16] == TEXTS[15][1]
    assert secrets.scan(table(spark, [])).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secrets.trigram_query("(abc|xyzw)q") == ("or", (("and", ("abc", "bcq")), ("and", ("xyz", "yzw", "zwq"))))
    assert secrets.trigram_query("ab?c") is None
    for rule in secrets.RULES:
        for text in ("Password: abcdefghijklm", "api_key=0123456789abcdef", "APIKEY = 0123456789abcdef", "AKIAABCDEFGHIJKLMN", "ghp_" + "a" * 40, "xoxb-0123456789ab"):
            if re.search(rule.pattern, text):
                assert holds(secrets.trigram_query(rule.pattern), text.lower())


def holds(query, text):
    return query is None or (query in text if isinstance(query, str) else (all if query[0] == "and" else any)(holds(q, text) for q in query[1]))


@pytest.mark.parametrize("block_chars", [1, 20_000, byte_bpe.BLOCK_CHARS])
def test_byte_bpe(spark, block_chars):
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_counts.rank_table(vocabulary("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = byte_bpe.encode(table(spark), block_chars=block_chars)
    same(got.selectExpr("doc_id", "array_join(ids, ',') AS ids"), [(i, ",".join(map(str, encoding.encode_ordinary(t or "")))) for i, t in TEXTS], ["doc_id", "ids"])
    back = byte_bpe.decode(got)
    same(back, [(i, bytearray((t or "").encode())) for i, t in TEXTS], ["doc_id", "raw"])
    if block_chars == byte_bpe.BLOCK_CHARS:
        wanted = [(i, len(e), sha(",".join(map(str, e))), sha(t)) for i, t in texts(spark) for e in [encoding.encode_ordinary(t)]]
        same(queries.op5_byte_bpe(spark, SMALL), wanted, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        assert byte_bpe.encode(table(spark, [])).count() == 0


def test_latin_text_splits_alike():
    import public_tokenizers
    import regex

    rng, find = np.random.default_rng(9), regex.compile(public_tokenizers.PATTERN).findall
    some = [c for c in map(chr, range(256)) if c not in "\x1c\x1d\x1e\x1f"]  # white space to Python alone
    for _ in range(300):
        text = "".join(rng.choice([*some, *" \n'st ab\xa0é½9"], rng.integers(0, 120)))
        assert byte_bpe.splitter(None)(text) == find(text)
    assert byte_bpe.splitter(None)("日本 x’s") == find("日本 x’s") and byte_bpe.splitter(r"\w+")("a b") == ["a", "b"]


def one_by_one(word: bytes, ranks):
    """Merge the lowest pair, the leftmost of equals, until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_fold_follows_any_rank_table(spark):
    """Ranks in which parts rank above the whole, and pairs of one token overlap."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 14))) for _ in range(400)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").coalesce(1)
    for seed in range(3):
        rng = np.random.default_rng(seed)
        longer = sorted({"".join(rng.choice(list("abc"), rng.integers(2, 6))).encode() for _ in range(60)})
        rng.shuffle(longer)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(longer)}
        folded = {r.w: [ord(c) - byte_bpe.SHIFT for c in r.t] for r in rows.select("w", byte_bpe.fold_word(rows["w"], ranks).alias("t")).collect()}
        assert folded == {w: one_by_one(w.encode(), ranks) for w in words}
        assert byte_bpe.careful(byte_bpe.merges(ranks))


def test_every_token_of_the_vocabulary_is_reached(spark):
    """The library gives a word that is a token that token; merges must come to the same."""
    ranks = token_counts.rank_table(vocabulary("byte_bpe_multi_50k.tiktoken"))
    tokens = spark.createDataFrame([(t, r) for t, r in ranks.items()], "w binary, r int")
    got = tokens.select("r", byte_bpe.fold_word(tokens["w"], ranks).alias("t"))
    assert got.filter("char_length(t) <> 1").count() == 0
    assert all(ord(r.t) - byte_bpe.SHIFT == r.r for r in got.collect())


def test_long_words_are_cut_where_no_merge_crosses(spark):
    import public_tokenizers
    import tiktoken

    ranks = token_counts.rank_table(vocabulary("byte_bpe_multi_50k.tiktoken"))
    rng = np.random.default_rng(2)
    long = [
        "a" * 3_000, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 300)),
        "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 1_000))), "=-" * 500 + "!" * 99, "é" * 1_000, "qzj" * 300,
    ]
    crossed = byte_bpe.crossings(ranks)
    assert all("".join(byte_bpe.pieces(w, crossed)) == w for w in long)
    encoding = tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = [(i, encoding.encode_ordinary(t)) for i, t in enumerate(long)]
    same(byte_bpe.encode(table(spark, list(enumerate(long)))), wanted, ["doc_id", "ids"])


def check_packing(pieces, wanted):
    """``wanted``: (doc_id, ids) of every row; ids may repeat."""
    from collections import Counter, defaultdict

    total, sequences, pieces_of = sum(len(x) for _, x in wanted), defaultdict(list), defaultdict(list)
    for p in pieces:
        assert 0 < p.length <= 2048
        sequences[p.sequence_id].append((p.offset, p.length))
        pieces_of[p.doc_id].append(p)
    for k, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 if k < len(sequences) - 1 else 0 < at <= 2048
    assert sorted(sequences) == list(range(-(-total // 2048)))
    crc = lambda x: zlib.crc32(struct.pack(f"<{len(x)}I", *x))
    ids_of = defaultdict(list)
    for i, x in wanted:
        ids_of[i].append(x)
    for i, xs in ids_of.items():
        seen = Counter((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces_of[i])
        if len(xs) == 1:
            at = 0
            for p in sorted(pieces_of[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(xs[0]) and p.ids_crc32 == crc(xs[0][at : at + p.length])
                at += p.length
            assert at == len(xs[0])
        assert sum(k[1] * n for k, n in seen.items()) == sum(map(len, xs))


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    pieces = packing.pack(table(spark))
    check_packing(pieces.collect(), [(i, ids(t)) for i, t in TEXTS])
    check_packing(queries.op4_packing(spark, "/root/testdata/sf0.01").collect(), [(r.doc_id, ids(r.text)) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()])
    assert packing.pack(table(spark, [])).count() == 0


def test_packing_takes_no_call_for_each_new_chunk():
    """CPU finding of op4_packing: unseen chunks of letters, or of letters before a mark, cost no calls of Python's each."""
    import cProfile
    import pstats

    from tokenizers import Tokenizer

    random = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüéßñ"))
    new = ["".join(letters[random.integers(0, len(letters), n)]) + ("", "", ",", ".", "|")[n % 5] for n in random.integers(3, 14, 20_000)]
    odd = ["", ".", "..", "a..", ".a", "it's", "don't.", "x1", "1.", "a,b", "²", "٠", "é", "́.", "ͅ", "ǅ.", "ﬁ!", "漢字。", "漢字.", "$$$", "a?!", "\x00", "a\x7f."]
    texts = [*odd, " ".join(odd), " " + "  ".join(odd) + "\n"]
    encoder, profile = packing.WordEncoder(vocabulary("word_bpe_49k.json")), cProfile.Profile()
    encoder.encode(["warm up"])  # imports
    ids = profile.runcall(encoder.encode, [" ".join(new)]) + encoder.encode(texts)
    assert pstats.Stats(profile).total_calls < 1000 < len(set(new))
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    for text, got in zip([" ".join(new), *texts], ids, strict=True):
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids

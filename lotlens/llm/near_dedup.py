"""Near-duplicate groups by BagMinHash: weighted-Jaccard signatures, banding, multiset verification.

A text is the multiset of its word 5-grams (lower-case words; a shorter text is one gram). For every
gram and dyadic band of its weight, (0,1], (1,2], (2,4], ..., a seeded Poisson process throws points on
the components; band j has 2^(j-1) times the unit rate and a point in the band that the weight only
partly covers is kept if its level lies below the weight. A component's signature is the earliest
point that reached it, so two texts agree in a component with a probability equal to the weighted
Jaccard similarity. Processes run in ascending time and stop once every component of the text has an
earlier point, so a text needs about m ln m + n points instead of m n.

Equal texts become one class first, with partial aggregation. Classes meet in a bucket when all rows of
a band agree. First each member is compared with four representatives of its bucket (smallest and
largest class, and two by hash), so pairs grow with the members. Pairs are verified on the multisets
themselves, and the verified links' connected components are found by minimum labels with pointer
jumping. Where a bucket's members were not all compared and still lie in several components, those
outside its largest component are then compared with all its members, exactly and in blocks of bounded
size, and the components joined. A link is missed only if no band of 25 brings its ends, or texts that
lead from one to the other, together. Joins on buckets, classes, heads and roots salt their hot keys.

Edge cases: null text counts as empty; texts without words are grouped only with equal texts; null ids
are carried and rank smallest; of a group the largest doc_id stays, and of rows that repeat one id and
text exactly one; a text of any length is sketched whole, by itself if it exceeds a batch; an empty table
gives an empty result; extra columns are ignored by :func:`near_duplicates` and carried along, whatever
their names, by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import files, hot_keys, hot_of, packed, salted_join, whole, written

GRAM = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
BATCH_CHARS = 1_500_000
BLOCK, BLOCK_GRAMS, COLUMNS = 256, 100_000, 2048  # members and grams of a block, grams compared at once

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def word_grams(texts: list[str], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word grams of the texts, in order, and the number of grams of each text."""
    import regex
    import xxhash

    find = regex.compile(r"\w+").findall
    words = [find(t.lower()) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    codes: dict[str, int] = {}
    flat = np.array([codes.setdefault(w, len(codes)) for ws in words for w in ws], np.int64)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    hashed = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in codes], np.uint64)[flat]
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(flat))  # words from here to the text's end
    out = np.full(len(flat), 0x51ED270B, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(gram):
            at = np.minimum(np.arange(len(flat)) + i, len(flat) - 1)
            out = np.where(left > i, mix(out * _M3 + hashed[at]), out)
    first = np.repeat(ends - sizes, sizes) == np.arange(len(flat))
    keep = (left >= gram) | (first & (np.repeat(sizes, sizes) < gram))
    return out[keep], np.where(sizes >= gram, sizes - gram + 1, np.minimum(sizes, 1))


def weights(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, weight) of the distinct grams of each text."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], grams[at], np.diff([*at, len(grams)])


def signatures(text: np.ndarray, gram: np.ndarray, weight: np.ndarray, n_texts: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(n_texts, m) signatures: for each component the hash of its earliest point, 0 for texts without grams."""
    best, who = np.full(n_texts * m, np.inf), np.zeros(n_texts * m, np.uint64)
    if not len(text):
        return who.reshape(n_texts, m)
    bands = np.ceil(np.log2(weight)).astype(np.int64) + 1  # dyadic bands that a weight reaches
    src = np.repeat(np.arange(len(text)), bands)
    band = np.arange(len(src)) - np.repeat(np.cumsum(bands) - bands, bands)
    low = np.where(band > 0, 2.0 ** (band - 1), 0.0)
    rate = np.where(band > 0, low, 1.0)
    share = (weight[src] - low) / rate  # the covered part of the band; above 1: all of it
    doc = text[src]
    with np.errstate(over="ignore"):
        seed = mix(gram[src] + _M3 * (band + 1).astype(np.uint64))
    clock, done = np.zeros(len(src)), 0
    while len(src):
        k = int(np.clip(40_000 // len(src), 1, 64))  # points of each process at a time
        with np.errstate(over="ignore"):
            point = mix(seed[:, None] + _M3 * np.arange(done + 1, done + k + 1, dtype=np.uint64))
            other = mix(point ^ _M2)
        done += k
        gaps = -np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / rate[:, None]
        time = clock[:, None] + np.cumsum(gaps, axis=1)
        component = ((other >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        level = (other & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32
        cell = doc[:, None] * m + component
        hit = np.flatnonzero((level < share[:, None]) & (time < best[cell]))
        if len(hit):
            order = hit[np.argsort(-time.ravel()[hit], kind="stable")]  # the earliest point of a cell is written last
            best[cell.ravel()[order]], who[cell.ravel()[order]] = time.ravel()[order], point.ravel()[order]
        clock = time[:, -1]
        live = clock < best.reshape(n_texts, m).max(1)[doc]
        src, rate, share, doc, seed, clock = src[live], rate[live], share[live], doc[live], seed[live], clock[live]
    return who.reshape(n_texts, m)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, m = signature.shape
    parts = signature.reshape(n, bands, m // bands)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n, 1))
    with np.errstate(over="ignore"):
        for i in range(m // bands):
            out = mix(out * _M3 + parts[:, :, i])
    return out.view(np.int64)


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_CHARS characters, a row at least."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(batch["size"].to_pylist()):
            if size and size + n > BATCH_CHARS:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def sketch(texts: DataFrame, keys: list[str], bands: int = BANDS, rows: int = ROWS, gram: int = GRAM) -> DataFrame:
    """``keys``, n (grams) and bands (array of bucket hashes, null for texts without words)."""
    schema = T.StructType([*[texts.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_size(batches):
            grams, sizes = word_grams(batch["text"].to_pylist(), gram)
            signature = signatures(*weights(grams, sizes), len(sizes), bands * rows)
            hashes = band_hashes(signature, bands)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sizes) + 1) * bands, bands, dtype=np.int32)), pa.array(hashes.ravel()), mask=pa.array(sizes == 0))
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], pa.array(sizes), lists], schema.names)

    return texts.select(*keys, "text", F.char_length("text").alias("size")).mapInArrow(run, schema)


def multisets(texts: DataFrame, key: str, gram: int = GRAM) -> DataFrame:
    """``key`` and bag: the grams as distinct 64-bit numbers, the k-th occurrence of a gram being its own.

    Rows that repeat a key within a partition are passed over.
    """
    schema = T.StructType([texts.schema[key], T.StructField("bag", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in _by_size(batches):
            fresh = [k not in seen and not seen.add(k) for k in batch[key].to_pylist()]
            batch = batch.filter(pa.array(fresh))
            text, grams, weight = weights(*word_grams(batch["text"].to_pylist(), gram))
            src = np.repeat(np.arange(len(text)), weight)
            nth = np.arange(len(src)) - np.repeat(np.cumsum(weight) - weight, weight)
            with np.errstate(over="ignore"):
                item = mix(grams[src] + _M2 * nth.astype(np.uint64)).view(np.int64)
            stops = np.searchsorted(text[src], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch[key], pa.ListArray.from_arrays(pa.array(stops), pa.array(item))], schema.names)

    return texts.select(key, "text", F.char_length("text").alias("size")).mapInArrow(run, schema)


def meetings(classes: DataFrame, most: int) -> DataFrame:
    """(bucket, cls, grams, members, heads) of every bucket with more than one member; heads represent the bucket.

    ``most`` bounds the number of classes times bands.
    """
    entries = classes.filter(F.col("bands").isNotNull()).select("cls", "grams", F.explode("bands").alias("bucket"))
    chosen = entries.groupBy("bucket").agg(
        F.count("*").alias("members"), F.min("cls").alias("r1"), F.max("cls").alias("r2"),
        F.min(F.struct(F.xxhash64(F.lit(1), "cls").alias("h"), "cls")).alias("r3"), F.min(F.struct(F.xxhash64(F.lit(2), "cls").alias("h"), "cls")).alias("r4"),
    )
    buckets = written(chosen.filter("members > 1").select("bucket", "members", F.array_distinct(F.array("r1", "r2", "r3.cls", "r4.cls")).alias("heads")), "buckets", most)
    total = buckets.agg(F.sum("members")).first()[0] or 0
    hot = hot_of(buckets.select("bucket", F.col("members").alias("n")), "bucket", total)
    return salted_join(entries, buckets, "bucket", ["cls"], hot).select("bucket", "cls", "grams", "members", "heads")


def candidate_pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of classes of which one represents a bucket that both are in."""
    pairs = met.select("cls", F.explode("heads").alias("head")).filter("cls <> head")
    return pairs.select(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b")).distinct()


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of shared elements of each left with each right array; within an array elements are distinct."""
    sides, (n, m) = [], (len(left), len(right))
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for arrays in (left, right):
        flat, row = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
        at = np.minimum(np.searchsorted(shared, flat), max(len(shared) - 1, 0))
        held = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[held], kind="stable")
        sides.append((row[held][order], at[held][order]))
    out = np.zeros((n, m), np.float32)
    for start in range(0, len(shared), COLUMNS):
        blocks = []
        for (row, at), k in zip(sides, (n, m), strict=True):
            lo, hi = np.searchsorted(at, (start, start + COLUMNS))
            block = np.zeros((k, min(COLUMNS, len(shared) - start)), np.float32)
            block[row[lo:hi], at[lo:hi] - start] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out.astype(np.int64)


def remaining_links(met: DataFrame, roots: DataFrame, bags: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between roots: the components that members of one bucket still have to join.

    ``roots`` has every class. Only buckets whose members were not all compared and lie in several
    components are read. Those outside the bucket's largest component meet all its members, in blocks
    of bounded size; within a block all pairs are compared on their multisets.
    """
    spark, entries = met.sparkSession, met.count()
    crowded = met.filter(F.size("heads") < F.col("members") - 1).select("bucket", "cls", "grams")
    rooted = written(crowded.join(roots, "cls"), "rooted", entries)
    parts = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("grams").alias("g"))
    plan = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("g").alias("g"), F.max(F.struct("n", "g", "root")).alias("main")).filter("parts > 1")
    blocks = lambda n, g: F.ceil(F.greatest(n / F.lit(BLOCK), g / F.lit(BLOCK_GRAMS)))
    plan = written(plan.select("bucket", F.col("main.root").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("g") - F.col("main.g")).alias("lefts"), blocks(F.col("n"), F.col("g")).alias("rights")), "blocks", entries)
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    if plan.isEmpty():
        return spark.createDataFrame([], schema)
    h = F.xxhash64(F.lit(3), "cls")
    i, j = F.pmod(h, "lefts"), F.pmod(h, "rights")
    as_left = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("rights") - 1), lambda x: F.struct(F.lit(True).alias("left"), i.alias("i"), x.alias("j")))
    as_right = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("lefts") - 1), lambda x: F.struct(F.lit(False).alias("left"), x.alias("i"), j.alias("j")))
    cells = F.when(F.col("root") == F.col("main"), as_right).otherwise(F.concat(as_left, as_right))
    dealt = salted_join(rooted, plan, "bucket", ["cls"], hot_keys(rooted, "bucket")).join(bags, "cls").select("bucket", "root", "bag", F.explode(cells).alias("cell")).select("bucket", "cell.i", "cell.j", "cell.left", "root", "bag")
    share = round(similarity * 1000)

    def compare(rows: pa.Table) -> pa.Table:
        names = rows["root"].combine_chunks().dictionary_encode()
        root, left = names.indices.to_numpy(), rows["left"].to_numpy().astype(bool)
        lists = rows["bag"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        bag = np.split(flat, ends[:-1])
        l, r = np.flatnonzero(left), np.flatnonzero(~left)
        found: list[tuple[int, int]] = []
        if len(l) and len(r) and len(names.dictionary) > 1:
            common = _common([bag[k] for k in l], [bag[k] for k in r])
            size = lists.value_lengths().to_numpy().astype(np.int64)
            enough = common * 1000 >= share * (size[l][:, None] + size[r][None, :] - common)
            x, y = np.nonzero(enough & (root[l][:, None] != root[r][None, :]))
            over = list(range(len(names.dictionary)))
            for p, q in np.unique(np.stack([root[l][x], root[r][y]]), axis=1).T.tolist():
                tops = []
                for k in (p, q):
                    while over[k] != k:
                        over[k] = k = over[over[k]]
                    tops.append(k)
                if tops[0] != tops[1]:
                    over[tops[0]] = tops[1]
                    found.append((p, q))
        pair = [names.dictionary.take(pa.array([f[k] for f in found], pa.int64())).cast(pa.binary()) for k in (0, 1)]
        return pa.table(pair, ["a", "b"])

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, schema).distinct()


def verified(pairs: DataFrame, bags: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a written table) whose multisets overlap enough: (a, b)."""
    left = bags.select(F.col("cls").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("cls").alias("b"), F.col("bag").alias("bag_b"))
    half = salted_join(pairs, left, "a", ["b"], hot_keys(pairs, "a"))
    both = salted_join(half, right, "b", ["a"], hot_keys(pairs, "b"))
    common = F.size(F.array_intersect("bag_a", "bag_b"))
    # exact in integers: common / (|a| + |b| - common) >= similarity
    enough = common * F.lit(1000) >= F.lit(round(similarity * 1000)) * (F.size("bag_a") + F.size("bag_b") - common)
    return both.filter(enough).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(cls, root): connected components of (a, b) links, each named by its smallest class."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(links.select(F.explode(ways).alias("way")).select("way.*"), "links")
    rows = both.count()
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cls"), F.least("a", "m").alias("root")), "roots", rows)
    hubs = hot_keys(both, "b")
    while True:
        heard = salted_join(both, labels.select(F.col("cls").alias("b"), "root"), "b", ["a"], hubs).groupBy("a").agg(F.min("root").alias("heard"))
        told = written(labels.join(heard.withColumnRenamed("a", "cls"), "cls", "left").select("cls", "root", F.least("root", "heard").alias("next")), "told", rows)
        jump = labels.select(F.col("cls").alias("next"), F.col("root").alias("beyond"))
        beyond = salted_join(told, jump, "next", ["cls"], hot_keys(told, "next"))
        after = written(beyond.select("cls", F.col("root").alias("old"), F.least("next", "beyond").alias("root")), "roots", rows)
        if after.filter("root <> old").isEmpty():
            return after.select("cls", "root")
        labels = after.select("cls", "root")


def _grouped(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """A row per doc_id and class: cls, doc_id, n (rows), class_id, group_id, group_size, stays (one of its rows is the group's); and the number of documents."""
    texts = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).withColumn("cls", F.unhex(F.md5("text")))
    sketched = written(sketch(texts, ["doc_id", "cls"], bands, rows, gram), "sketch")
    total = sketched.count()
    classes = sketched.groupBy("cls").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.max("n").alias("grams"))
    classes = written(classes, "classes", total * 8)  # its rows are that much wider
    met = written(meetings(classes, total * bands), "met", total * bands)
    pairs = written(candidate_pairs(met), "pairs", met.count())
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "doc_id"), "cls")
    wanted = needed.select("cls", F.col("doc_id").alias("__id"))
    chosen = texts.join(wanted.hint("shuffle_hash"), (texts["cls"] == wanted["cls"]) & texts["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
    bags = written(multisets(chosen.select("cls", "text"), "cls", gram), "bags")
    roots = components(verified(pairs, bags, similarity).repartition(files(pairs.count())))
    named = classes.select("cls", F.col("doc_id").alias("class_id"), "copies").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = written(named, "named", total)
    rest = written(remaining_links(met, named.select("cls", "root"), bags, similarity), "rest")
    if not rest.isEmpty():
        beyond = components(rest).select(F.col("cls").alias("root"), F.col("root").alias("beyond"))
        named = written(named.join(beyond, "root", "left").withColumn("root", F.coalesce("beyond", "root")).drop("beyond"), "named", total)
    groups = written(named.groupBy("root").agg(F.max(F.struct("class_id", "cls")).alias("lead"), F.sum("copies").alias("group_size")), "roots", total)
    groups = groups.select("root", F.col("lead.class_id").alias("group_id"), F.col("lead.cls").alias("lead"), "group_size")
    of_class = written(salted_join(named, groups, "root", ["cls"], hot_keys(named, "root")).select("cls", "class_id", "group_id", "group_size", (F.col("cls") == F.col("lead")).alias("leads")), "groups", total)
    counted = sketched.groupBy("cls", "doc_id").agg(F.count("*").alias("n"))
    hot = hot_of(classes.select("cls", F.col("copies").alias("n")), "cls", total)
    counted = salted_join(counted, of_class, "cls", ["doc_id"], hot)
    return counted.withColumn("stays", F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).drop("leads"), total


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (equal texts), group_id (near duplicates), group_size, kept.

    Both ids are the largest doc_id of the class or group, and that document stays; of several texts with
    that id the one whose hash is largest.
    """
    counted, _ = _grouped(docs, similarity, bands, rows, gram, id_col, text_col)
    out = counted.select("doc_id", "class_id", "group_id", "group_size", "stays", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    return out.select("doc_id", "class_id", "group_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group: the row :func:`near_duplicates` keeps, found by id and text."""
    counted, total = _grouped(docs, id_col=id_col, text_col=text_col, **options)
    stay = written(counted.filter("stays").select(F.col("doc_id").alias("stay_id"), F.col("cls").alias("stay_cls"), (F.col("n") > 1).alias("repeated")), "stay", total)
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    keyed = packed(docs).select("row", F.col(f"row.`{id_col}`").alias("row_id"), F.unhex(F.md5(text)).alias("row_cls"))

    def rows(keys: DataFrame) -> DataFrame:
        return keyed.join(keys, (F.col("row_cls") == F.col("stay_cls")) & F.col("row_id").eqNullSafe(F.col("stay_id")), "left_semi")

    out, repeated = rows(stay.filter("NOT repeated")).select("row"), stay.filter("repeated")
    if not repeated.isEmpty():  # of rows with one id and text the one whose other columns hash highest
        best = rows(repeated).groupBy("row_cls", "row_id").agg(F.max_by("row", F.xxhash64("row")).alias("row"))
        out = out.unionByName(best.select("row"))
    return out.select("row.*")

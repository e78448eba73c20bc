"""Operators that compare documents, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import regex

import corpus_pipeline
from lotlens.llm import base, exact_dedup, line_dedup, near_dedup, queries, sharding, toxicity

from .corpus import BASE, TEXTS, same, table

SF = "/root/testdata/sf0.01"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def brute_exact(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, sha(t)))
            first = first and i != keep
    return out


def test_exact_dedup(spark):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    same(exact_dedup.duplicate_groups(table(spark)), brute_exact(TEXTS), columns)
    same(queries.op10_exact_dedup(spark, SF), brute_exact(documents(spark)), columns)
    assert exact_dedup.duplicate_groups(table(spark, [])).count() == 0
    kept = exact_dedup.drop_duplicates(table(spark))
    assert kept.columns == table(spark).columns
    same(kept.selectExpr("doc_id", "coalesce(text, '') AS text"), [(i, t) for t, i in {t or "": max((j for j, u in TEXTS if (u or "") == (t or "") and j is not None), default=None) for _, t in TEXTS}.items()], ["doc_id", "text"])


def test_bloom_lets_unique_rows_pass(spark):
    df = spark.range(20_000).selectExpr("id", "xxhash64(CASE WHEN id % 100 = 0 THEN 0 ELSE id END) AS h")
    flag = exact_dedup.possibly_repeated(df, df["h"])
    hit = df.withColumn("hit", flag).groupBy((df["id"] % 100 == 0).alias("copy"), "hit").count().collect()
    counts = {(r["copy"], r["hit"]): r["count"] for r in hit}
    assert (True, False) not in counts and counts.get((False, True), 0) < 600


def brute_lines(texts):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(h := holders.get(key(x), set()) - {None}) >= 3 and max(h) != i)]
        out.append((i, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return out


def test_line_dedup(spark):
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    kept = line_dedup.drop_shared_lines(table(spark)).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256) AS kept_sha256")
    assert sum(x[2] for x in brute_lines(TEXTS)) == 3
    same(kept, brute_lines(TEXTS), columns)
    same(queries.op7_line_dedup(spark, SF), brute_lines(documents(spark)), columns)
    assert line_dedup.drop_shared_lines(table(spark, [])).count() == 0


def check_shards(rows, texts, shards=16):
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and {r.law for r in rows} == {"rows"}
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    by = {}
    for i, t in texts:
        by[i] = (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert all(by[r.doc_id] == (r.size, r.text_crc32) for r in rows)


def cut(rows):
    places = defaultdict(set)
    for r in rows:
        places[(r.text_crc32, r.size)].add(r.shard)
    return sum(len(p) - 1 for p in places.values())


def test_sharding(spark):
    check_shards(sharding.assign_shards(table(spark)).collect(), TEXTS)
    rows = queries.op6_sharding(spark, SF).collect()
    check_shards(rows, documents(spark))
    groups = Counter((r.text_crc32, r.size) for r in rows)
    assert cut(rows) <= 0.1 * sum(n - 1 for n in groups.values())
    hot = [(i, "same" if i % 3 == 0 else f"pair {i // 2}" if i % 7 else f"t{i}") for i in range(900)]
    rows = sharding.assign_shards(table(spark, hot)).collect()
    check_shards(rows, hot)
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"same")}) <= 9
    check_shards(sharding.assign_shards(table(spark, [(i, "same") for i in range(100)])).collect(), [(i, "same") for i in range(100)])
    assert sharding.assign_shards(table(spark, [])).count() == 0


def bag(t, n=5):
    w = regex.findall(r"\w+", (t or "").lower())
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_groups(texts):
    """Connected components of equal texts and pairs at 0.8 or more: a frozenset of texts each."""
    distinct = list(dict.fromkeys(t or "" for _, t in texts))
    bags, root = [bag(t) for t in distinct], list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = defaultdict(set)
    for k, b in enumerate(bags):
        for g in b:
            holders[g].add(k)
    for k, b in enumerate(bags):
        for j in {j for g in b for j in holders[g] if j > k}:
            if jaccard(b, bags[j]) >= 0.8:
                root[find(j)] = find(k)
    return {t: find(k) for k, t in enumerate(distinct)}


def test_near_dedup(spark):
    for df, texts in ((near_dedup.near_duplicates(table(spark)), TEXTS), (queries.op8_near_dedup(spark, SF), documents(spark))):
        group = brute_groups(texts)
        members = defaultdict(list)
        for i, t in texts:
            members[group[t or ""]].append(i)
        wanted = []
        for ids in members.values():
            keep = max((i for i in ids if i is not None), default=None)
            first = True
            for i in ids:
                wanted.append((i, keep, len(ids), i == keep and first))
                first = first and i != keep
        same(df, wanted, ["doc_id", "group_id", "group_size", "kept"])
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    left = near_dedup.drop_near_duplicates(table(spark, [x for x in TEXTS if x[0] is not None]))
    assert {9, 10}.isdisjoint(r.doc_id for r in left.collect()) and left.columns == table(spark).columns


def edited_copies(n, first=1000, name="item", edits=4):
    """An original (with the middle id) and n copies of it with so many words replaced: each at 0.8 or more to it, most pairs below."""
    rng, words = np.random.default_rng(7), [f"{name}{i}" for i in range(200)]
    out = [(first + n // 2, " ".join(words))]
    for k in range(n):
        at = set((rng.permutation(edits) * 50 + rng.integers(0, 45, edits)).tolist())
        out.append((first + k + (k >= n // 2), " ".join(f"{name}new{k}x{i}" if i in at else w for i, w in enumerate(words))))
    return out


def groups_by_brute_force(texts):
    group, members = brute_groups(texts), defaultdict(list)
    for i, t in texts:
        members[group[t or ""]].append(i)
    return [(i, max(ids), len(ids)) for ids in members.values() for i in ids]


def test_near_dedup_original_and_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 64, raising=False)
    texts = edited_copies(300) + edited_copies(40, 5000, "other", 3) + [(i, t) for i, t in TEXTS if i in (9, 10, 11, 20)]
    wanted = groups_by_brute_force(texts)
    assert Counter(w[2] for w in wanted)[301] == 301
    same(near_dedup.near_duplicates(table(spark, texts)), wanted, ["doc_id", "group_id", "group_size"])
    left = near_dedup.drop_near_duplicates(table(spark, texts)).select("doc_id").collect()
    assert sorted(r.doc_id for r in left) == sorted({w[1] for w in wanted})


def test_near_dedup_writes_few_files(spark, monkeypatch):
    """Scratch tables have as many files as their rows need, however many tasks a stage has."""
    texts = edited_copies(60) + TEXTS[:1]
    wanted = groups_by_brute_force(texts)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rows, most in ((1 << 18, 1), (16, 1 << 20)):
            monkeypatch.setattr(base, "FILE_ROWS", rows, raising=False)
            base.sweep(spark)
            same(near_dedup.near_duplicates(table(spark, texts)), wanted, ["doc_id", "group_id", "group_size"])
            folder = Path(base.scratch_dir(spark).removeprefix("file://"))
            found = {d.name: len(list(d.glob("part-*"))) for d in folder.iterdir()}
            assert {"sketch", "met", "links", "named", "rest"} <= {name.split("-")[0] for name in found}
            assert all(n <= most for name, n in found.items() if name.split("-")[0] not in ("sketch", "bags", "links", "rest")), found
            assert not any(name.startswith("hot-") for name in found)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_near_dedup_null_and_repeated_ids(spark):
    near = [BASE.replace("term5 ", f"zzz{k} ") for k in range(3)]
    texts = [(None, near[0]), (None, near[1]), (None, "alone one two three four five"), (7, near[2].replace("term", "word")), (7, near[1].replace("term", "word")), (7, "other text"), (7, "other text")]
    rows = near_dedup.near_duplicates(table(spark, texts)).collect()
    assert len(rows) == 7 and sum(r.kept for r in rows) == 4
    left = [(r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(table(spark, texts)).collect()]
    assert len(left) == 4 and set(left) <= set(texts)
    group = brute_groups(texts)
    assert Counter(group[t] for _, t in left) == Counter(set(group.values()))


def test_pipeline_keeps_one_of_many_edited_copies(spark, tmp_path):
    texts = [*edited_copies(120), *edited_copies(20, 5000, "other", 3), (1, "a lone text"), (2, "a lone text"), (3, "another text of its own")]
    table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {keep for _, keep, _ in groups_by_brute_force(texts)} and len({r.doc_id for r in rows}) == 4
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    assert all(lengths[r.doc_id] == r.doc_tokens for r in rows)


def test_bagminhash_estimates_weighted_jaccard():
    words = BASE.split()
    texts = [" ".join(words), " ".join(words[:150] + ["q"] * 90), " ".join(["q"] * 130 + words[60:]), "q " * 40, "a b"]
    grams, sizes = near_dedup.word_grams(texts)
    text, gram, weight = near_dedup.weights(grams, sizes)
    sig = near_dedup.signatures(text, gram, weight, len(texts), 4000)
    bags = [bag(t) for t in texts]
    for i in range(5):
        for j in range(i):
            assert abs((sig[i] == sig[j]).mean() - jaccard(bags[i], bags[j])) < 0.03
    again = near_dedup.signatures(*near_dedup.weights(*near_dedup.word_grams(texts[1:2])), 1, 4000)
    assert (again[0] == sig[1]).all()


def test_toxicity_held_out(spark):
    rows = {r.doc_id: r for r in queries.op9_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    held = [(labels[i], r.predicted) for i, r in rows.items() if r.held_out and i in labels]
    hit = Counter(held)
    # one toxic label in ten at this size is on a text whose words were overwritten by junk
    assert hit[1, 1] / (hit[1, 1] + hit[1, 0]) >= 0.85 and hit[0, 1] / (hit[0, 0] + hit[0, 1]) <= 0.01


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = table(spark, [(i, "you idiot fool" if i % 2 else "nice calm day") for i in range(40)] + [(None, None), (99, ""), (100, "idiot")])
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 43 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(table(spark, []), model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.filter("toxic = 0"))).collect()} == {0.0}
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {0, 2, 99}


def test_counterfactual_penalty_shrinks_identity_effects():
    rng = np.random.default_rng(3)
    hasher, texts, y = toxicity.Hasher(), [], []
    for k in range(600):
        toxic = int(rng.random() < 0.3)
        words = list(rng.choice(["alpha", "beta", "gamma", "delta"], 6))
        words += ["women"] if rng.random() < (0.8 if toxic else 0.2) else ["men"]
        words += ["vile"] if toxic and rng.random() < 0.8 else []
        texts.append(words)
        y.append(toxic)
    features = [hasher.text(w) for w in texts]
    swaps = [toxicity.difference(features[k], hasher.text(o)) for k, w in enumerate(texts) for o in toxicity.swapped(w)]

    def gap(penalty):
        model = toxicity.fit(features, np.array(y), swaps, penalty)
        z = lambda w: float(model.weights[hasher.text(w)].sum())
        return abs(z(["alpha", "women"]) - z(["alpha", "men"])), z(["alpha", "vile"]) - z(["alpha"])

    (free, _), (held, signal) = gap(0.0), gap(5.0)
    assert held < 0.2 * free and signal > 1
    assert toxicity.swapped(["the", "women", "spoke"]) == [["the", "men", "spoke"]] and toxicity.swapped(["a"]) == []


def test_the_corpus_has_identity_swaps(spark):
    """Labelled texts of the test tables do hold terms that are swapped (pronouns), so the penalty is evaluated."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    features, y, swaps = toxicity.examples(docs, labels)
    assert 200 < len(features) == len(y) <= toxicity.MAX_ROWS and len(swaps) > 50
    model = toxicity.fit(features, y, swaps, always=toxicity.term_features())
    plain = toxicity.fit(features, y, [])
    z = lambda m, f: float(m.weights[f].sum())
    moved = lambda m: float(np.mean([abs(z(m, more) - z(m, less)) for more, less in swaps]))
    assert moved(model) <= moved(plain) + 0.05 and moved(model) < 0.1


def test_fit_against_a_loop(spark):
    rng = np.random.default_rng(4)
    features = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(40)]
    y = np.array([int(3 in f or rng.random() < 0.2) for f in features])
    swaps = [(k, np.sort(rng.choice(12, 4, replace=False))) for k in range(0, 40, 3)]
    steps, rate, penalty, l2 = 25, 0.3, 1.5, 1e-3
    used = [f for f in range(12) if sum(f in x for x in features) >= 1]
    share = [0.5 / y.sum() if v else 0.5 / (len(y) - y.sum()) for v in y]
    w, b, gw, gb = dict.fromkeys(used, 0.0), 0.0, dict.fromkeys(used, 1e-8), 1e-8
    for _ in range(steps):
        z = [sum(w.get(f, 0) for f in x) + b for x in features]
        grad, step_b = {f: l2 * w[f] for f in used}, 0.0
        for x, v, s, logit in zip(features, y, share, z):
            err = s * (1 / (1 + np.exp(-logit)) - v)
            step_b += err
            for f in x:
                grad[f] += err
        for r, other in swaps:
            change = 2 * penalty / len(swaps) * (sum(w.get(f, 0) for f in other) + b - z[r])
            for f in other:
                if f in grad:
                    grad[f] += change
            for f in features[r]:
                grad[f] -= change
        for f in used:
            gw[f] += grad[f] ** 2
            w[f] -= rate * grad[f] / gw[f] ** 0.5
        gb += step_b**2
        b -= rate * step_b / gb**0.5
    model = toxicity.fit(features, y, [toxicity.difference(features[r], other) for r, other in swaps], penalty, l2, steps, rate, 1, 0.0)
    assert abs(model.bias - b) < 1e-6 and all(abs(model.weights[f] - w[f]) < 1e-5 for f in used)


def test_scores_are_the_models_sums(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model, hasher = toxicity.train(docs, labels), toxicity.Hasher()
    texts = dict(documents(spark))
    for r in toxicity.score(docs, model).collect():
        z = sum(float(model.weights[f]) for f in {f for w in toxicity.words_of(texts[r.doc_id] or "") for f in hasher.word(w)}) + model.bias
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6 and r.predicted == int(r.score >= 0.7)


def test_repeated_ids_do_not_grow_the_sample(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 5, "doc_id long, toxic int")
    docs = table(spark, [(i, f"{'vile' if i % 2 else 'calm'} text {i} copy {k}") for i in range(40) for k in range(6)])
    features, y, _ = toxicity.examples(docs, labels, max_rows=70)
    assert len(features) == len(y) == 70

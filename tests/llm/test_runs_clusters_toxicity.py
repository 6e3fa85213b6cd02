"""Periodic runs, centroid clusters and toxicity against brute force and held-out labels."""

import hashlib
import itertools
import math
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobscope.llm import clustering, periodic, toxicity


def plain_runs(words, longest=None):
    """Every period (up to longest), every stretch; of a stretch the least period."""
    found = {}
    for q in range(1, (longest or len(words) // 4) + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(200):
        texts = []
        for _ in range(rng.randint(0, 4)):
            t = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.choice([0, 1, 5, 6, 30, 90]))]
            if len(t) > 12:
                i, q = rng.randrange(len(t) - 6), rng.randint(1, 7)
                for k in range(i + q, min(len(t), i + q * rng.randint(3, 9) + rng.randint(0, 3))):
                    t[k] = t[k - q]
            texts.append(t)
        first = np.cumsum([0] + [len(t) for t in texts])
        got = periodic.runs(np.array(sum(texts, []), dtype=np.uint64), first).tolist()
        assert got == [[s + int(first[k]), n, q] for k, t in enumerate(texts) for s, n, q in plain_runs(t)]


def test_long_periodic_texts():
    for values, expected in ((np.zeros(60_000), [[0, 60_000, 1]]), (np.arange(60_000) % 9000, [[0, 60_000, 9000]])):
        assert periodic.runs(values.astype(np.uint64), np.array([0, 60_000])).tolist() == expected
    noise = np.random.default_rng(0).integers(0, 2, 20_000)
    assert periodic.runs(noise.astype(np.uint64), np.array([0, 20_000])).tolist() == [list(x) for x in plain_runs(noise.tolist(), 40)]  # noise has no longer ones


def expected_row(doc_id, text, plant):
    words = (text or "").encode().split()
    n = len(words)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and n and h % 10 == 0:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "a a a a a a a"), (4, "x " * 5), (5, "x " * 6), (6, "x y x y x y x y"), (7, "Ein\x0bWort zwei " * 9), (8, "a b c " * 3000), (5, "x " * 6)]
    rows += [(k, " ".join(f"w{(i * i) % 23}" for i in range(k % 37))) for k in range(100, 220)]
    docs = spark.createDataFrame([(*x, 7, "s") for x in rows], "doc_id long, text string, n_runs int, start string")
    for plant in (False, True):
        got = sorted(map(tuple, periodic.describe_runs(docs.repartition(3), plant).collect()), key=repr)
        assert got == sorted((expected_row(*x, plant) for x in rows), key=repr)
    assert periodic.describe_runs(docs.where("false")).count() == 0


def plain_lloyd(vectors, start, rounds):
    centroids = [list(map(int, c)) for c in start]
    for t in range(rounds + 1):
        near = [min(range(len(centroids)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, centroids[c], strict=True)), c)) for v in vectors]
        if t < rounds:
            for c in range(len(centroids)):
                own = [v for v, x in zip(vectors, near, strict=True) if x == c]
                if own:
                    centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return near, centroids


@pytest.mark.parametrize("spread", [2, 40, 1 << 26])
def test_clusters_match_plain_rounds(spark, spread):
    rng = np.random.default_rng(spread)
    vectors = [(rng.integers(-spread, spread, 4) + rng.choice([0, spread])).clip(1 - (1 << 27), 1 << 27).tolist() for _ in range(300)]
    vectors += vectors[:40] + [vectors[0]] * 60  # ties and repeated rows
    start = np.array(vectors[:9] + [vectors[0]])  # two centroids alike: the second stays empty
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, v array<int>").repartition(3)
    found = clustering.lloyd(df, start, 6)
    near, centroids = plain_lloyd(vectors, start, 6)
    assert found.centroids.tolist() == centroids
    assert {x.vec_id: x.cluster for x in found.assigned.collect()} == dict(enumerate(near)) and found.assigned.count() == len(vectors)


def test_settled_vectors_stay_in_their_heaps(spark):
    rng = np.random.default_rng(3)
    vectors = [(rng.integers(-9, 9, 8) + 1000 * (k % 4)).tolist() for k in range(400)]
    found = clustering.lloyd(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, v array<int>"), np.array(vectors[:4]), 5)
    assert found.scanned[0] == 400 and sum(found.scanned[1:]) == 0 and found.assigned.count() == 400


def test_clusters_of_odd_rows(spark, tmp_path):
    good = [0.5] * 64
    rows = [(1, good), (2, None), (3, [0.1] * 63), (4, [float("nan")] + [0.0] * 63), (5, [None] + [0.0] * 63), (6, [float("inf")] + [0.0] * 63), (None, good), (1, good), (7, [-1e-9] * 64), (8, [3e38] * 64)]
    table = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<float>, cluster int, distance int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = clustering.op12_centroid_clusters(spark, str(tmp_path)).collect()
    assert sorted((x.vec_id or 0, x.distance) for x in got) == [(0, 0), (1, 0), (1, 0), (7, 0), (8, 0)]
    assert clustering.quantised(table.where("vec_id = 7")).first().v == [-1] * 64 and clustering.quantised(table.where("vec_id = 8")).first().v == [1 << 27] * 64
    table.where("false").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert clustering.op12_centroid_clusters(spark, f"{tmp_path}/none").count() == 0


def readings(token):
    """All readings of a short token with their symbols and costs."""
    symbol, place, (read, price) = toxicity._letters()[0], toxicity._options()[0], toxicity._options()[1:]
    codes = [ord(c) for c in token]
    choices = []
    for k, c in enumerate(codes):
        if place[c] == 0:
            back = k > 0 and codes[k - 1] == c
            more = back and ((k + 1 < len(codes) and codes[k + 1] == c) or (k > 1 and codes[k - 2] == c))
            own = [(int(symbol[c]), chr(c), toxicity.KEEP_MORE if more else 0.0)]
            if back:
                own.append((-1, "", toxicity.DROP_MORE if more else toxicity.DROP_TWO))
        else:
            spaced = toxicity.SPACED_END if c in (codes[k - 2] if k > 1 else None, codes[k + 2] if k + 2 < len(codes) else None) else 0.0
            own = [(int(s), "" if s < 0 else " " if s == 0 else chr(96 + s), float(x) + spaced * (s == 0)) for s, x in zip(read[place[c]], price[place[c]], strict=True) if s > -2]
        choices.append(own)
    for path in itertools.product(*choices):
        yield path


def value(model, path):
    context, total = 0, 0.0
    for s, _, cost in path:
        total -= cost
        if s >= 0:
            total += float(model[context, s])
            context = 0 if s == 0 else (context * toxicity.SYMBOLS + s) % toxicity.CONTEXTS
    return total + float(model[context, 0])


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(5)
    model = np.log(rng.dirichlet(np.full(toxicity.SYMBOLS, 0.3), toxicity.CONTEXTS) + 1e-6).astype(np.float32)
    for token in ("1d10t", "st*pid", "s.t.u.p", "a b c", "loooser", "l0ss3r", "$$aab", "éé1", "тест1", "p@t#3t1c", "looss", "aaaaaa", "x"):
        codes = np.array([ord(c) for c in token], dtype=np.uint32)
        width = 2 if all(toxicity._letters()[0][codes] >= 0) else 7
        got = "".join(map(chr, toxicity.decode(model, codes, np.array([0]), np.array([len(codes)]), width)[0].tolist()))
        by = {}
        for path in readings(token):
            text = "".join(x for _, x, _ in path)
            by[text] = max(by.get(text, -math.inf), value(model, path))
        assert abs(by[got] - max(by.values())) < 1e-4, (token, got, max(by, key=by.get))


def disguised(word, k):
    """word in leetspeak, spaced, or with repeated letters."""
    leet = str.maketrans({"o": "0", "i": "1", "e": "3", "a": "@", "s": "$"})
    return (word.translate(leet), " ".join(word), "".join(c * (3 if j == 2 else 1) for j, c in enumerate(word)), ".".join(word), word)[k % 5]


def test_toxicity_held_out_and_disguised(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert len(got) > 50 and sum((x.score >= 0.5) == (x.toxic == 1) for x in got) >= 0.97 * len(got)
    # Clean texts with a few disguised words among theirs, and the same texts without.
    words = ["loser", "idiot", "moron", "pathetic", "disgusting", "worthless"]
    clean = [x.text.split()[:150] for x in docs.join(labels.where("toxic = 0 and quality = 1"), "doc_id").where(F.col("lang") == "en").limit(40).collect()]
    rows = []
    for k, text in enumerate(clean):
        bad = list(text)
        for j in range(3):
            bad.insert((7 + 31 * j) % (len(bad) + 1), disguised(words[(k + j) % len(words)], k + j))
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(bad))]
    found = {x.doc_id: x.score for x in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    hit = [found[2 * k + 1] >= 0.5 for k in range(len(clean))]
    assert len(hit) == 40 and sum(hit) >= 36 and sum(found[2 * k] >= 0.5 for k in range(len(clean))) <= 2
    texts = [(1, "you l0s3r, s t u p i d looser!"), (2, None), (3, ""), (4, "clean words")]
    read = {x.doc_id: x for x in toxicity.restored(spark.createDataFrame(texts, "doc_id long, text string"), model.letters).collect()}
    assert read[1].text.startswith("you loser, ") and read[2].text is None and read[3].text == "" and (read[4].text, read[4].n_restored) == ("clean words", 0)


def test_toxicity_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 456"), (None, "good words"), (4, "bad loser " * 50_000), (4, "bad loser"), (5, "​ � 漢字 !!! $$$"), (6, "a b a b")]
    docs = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, toxic int, score string")
    for labels in ([], [(1, 1), (4, 1), (4, 0), (None, 1), (9, 1)], [(1, 0), (2, 0)], [(4, 1), (6, 0), (2, None), (3, 7)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.score(docs.repartition(2), model).collect()
        assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
        if labels and all(y == 1 for _, y in labels[:1]) and len(labels) == 5:
            assert all(x.score > 0.99 for x in got)
        if len(labels) in (0, 2):
            assert all(x.score < 0.01 for x in got)
    assert toxicity.score(docs.where("false"), model).count() == 0

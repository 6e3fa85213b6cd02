"""Operators on texts against brute force, and the odd inputs: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
import time
import tracemalloc
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobscope.llm import decontaminate, jaccard, langid, licenses, media, mixing, pii, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, hash string, node string, key string, place string, target string"


def frame(spark, rows):
    """rows: (doc_id, text, lang, source); with more columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "x", "x", "x", "x", "x") for i, t, lang, s in rows], SCHEMA)


def rnd_text(r, n, vocabulary=6):
    return " ".join(r.choice([f"w{k}" for k in range(vocabulary)]) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(5)
    base = [f"{a}{b}" for a, b in itertools.product("abcdefghij", "klmnopqrst")]
    long = " ".join(r.choice(base) for _ in range(60_000))
    passage = " ".join(r.choice(base) for _ in range(45))
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, " \t\n ", "en", "a"), (3, "one", "en", ""), (3, "one", "en", ""), (None, "two words", None, "b"), (None, None, None, None)]
    rows += [(4, long, "en", "a"), (5, f"x y {passage} z", "en", "a"), (6, f"q {passage} r s {passage}", "fr", "b"), (7, f"Q {passage} R S {passage}", "fr", None), (8, long + " end", "en", "b")]
    rows += [(20 + k, rnd_text(r, r.randint(1, 80)), "en", "a") for k in range(30)]
    rows += [(60 + k, f"{passage} {rnd_text(r, 3)}", "fr", "b") for k in range(8)]
    rows += [(70, rows[-1][1], "fr", "b"), (70, "another text of the same id", "fr", "b")]
    return rows


def brute_windows(rows, n=20):
    docs = [(i if i is not None else 1 << 63, t, (t or "").split()) for i, t, *_ in rows]
    first = {}
    for i, _, w in docs:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, _, w in docs:
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (i, k):
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((None if i == 1 << 63 else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def order(rows):
    return sorted(rows, key=lambda x: tuple((y is None, y) for y in x))


def test_substrings_match_brute_force(spark, odd_rows):
    got = substrings.remove_repeats(frame(spark, odd_rows).repartition(3)).select("doc_id", "n_words", "n_removed", "kept_sha256", "text").collect()
    assert order(map(tuple, got)) == order(brute_windows(odd_rows))


@pytest.mark.parametrize("seed", range(2))
def test_substrings_of_small_vocabulary(spark, seed):
    r = random.Random(seed)
    rows = [(k, rnd_text(r, r.randint(0, 150), 2), "en", "a") for k in range(40)]
    rows += [(100 + k, " ".join([rnd_text(r, 30, 3), rows[k][1][:150]]), "en", "a") for k in range(20)]
    got = substrings.remove_repeats(frame(spark, rows).repartition(5)).select("doc_id", "n_words", "n_removed", "kept_sha256", "text").collect()
    assert order(map(tuple, got)) == order(brute_windows(rows))


def test_substrings_of_a_hot_anchor(spark, monkeypatch):
    r = random.Random(7)
    line = " ".join(f"line{k}" for k in range(14))
    words = lambda n: " ".join(f"u{r.randint(0, 30_000)}" for _ in range(n))
    rows = [(k, f"{words(r.randint(0, 14))} {line} {words(r.randint(0, 14))}", "en", "a") for k in range(150)]
    rows += [(200 + k, f"{words(3)} {rows[k * 3][1]} {words(4)}", "en", "a") for k in range(40)]
    for hot in (2, 32, 1000):
        monkeypatch.setattr(substrings, "HOT", hot)
        got = substrings.remove_repeats(frame(spark, rows).repartition(4)).select("doc_id", "n_words", "n_removed", "kept_sha256", "text").collect()
        assert order(map(tuple, got)) == order(brute_windows(rows))


def shingles(text, n=5):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return [(rows[k][0], len(sets[k]), least[find(k)] if sets[k] else rows[k][0]) for k in range(len(rows))]


def near_copies(r, n):
    rows = []
    for k in range(n):
        w = [f"v{r.randint(0, 400)}" for _ in range(r.randint(6, 120))]
        for c in range(r.randint(1, 6)):
            x = list(w)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                x[r.randrange(len(x))] = f"n{r.randint(0, 9)}"
            rows.append((k * 10 + c, " ".join(x), "en", "a"))
    return rows


def test_jaccard_matches_brute_force(spark, odd_rows):
    rows = odd_rows + [(i + 1000, *x) for i, *x in near_copies(random.Random(3), 40)]
    got = jaccard.link(frame(spark, rows).repartition(5)).select("doc_id", "n_shingles", "component_id").collect()
    assert order(map(tuple, got)) == order(brute_components(rows))


def test_linked_sets_share_a_signature():
    r = random.Random(8)
    rows = near_copies(r, 120)
    s = jaccard.Shingles([t.encode() for _, t, *_ in rows])
    for share in (0.0, 0.4, 0.9, 1.0):
        frequent = np.array(sorted(v for v in set(s.values.tolist()) if r.random() < share), dtype=np.uint64)
        found, row = s.signatures(frequent)
        by = {}
        for x, k in zip(found.tolist(), row.tolist(), strict=True):
            by.setdefault(k, set()).add(x)
        sets = [set(s.values[s.row == k].tolist()) for k in range(len(rows))]
        for a, b in itertools.combinations(range(len(rows)), 2):
            common = len(sets[a] & sets[b])
            if sets[a] != sets[b] and common and 100 * common >= 80 * len(sets[a] | sets[b]):
                assert by[a] & by[b], (share, len(sets[a]), len(sets[b]))


def test_slices_of_empty_sets_and_of_repeats(spark, monkeypatch):
    for texts in ([], [b""], [b" \t"] * 3):
        assert [len(x) for x in jaccard.Shingles(texts).signatures(np.zeros(0, dtype=np.uint64))] == [0, 0]
    monkeypatch.setattr(jaccard, "SLICE", 64)  # each text is a slice, most hold only what was seen before, or no words
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(k, text if k % 3 else None if k % 2 else "  ", "en", "a") for k in range(12)]
    got = {x.doc_id: x.component_id for x in jaccard.link(frame(spark, rows).coalesce(1)).collect()}
    assert got == {k: 1 if k % 3 else k for k in range(12)}


def test_keep_one_of_each_component(spark, odd_rows):
    rows = odd_rows + [(i + 1000, *x) for i, *x in near_copies(random.Random(4), 10)]
    kept = jaccard.keep_one(frame(spark, rows)).collect()
    linked = brute_components(rows)
    expected = {c for _, n, c in linked if n and c is not None}
    with_words = [x for x in kept if shingles(x.text)]
    assert {x.doc_id for x in with_words if x.doc_id is not None} == expected
    assert len(kept) - len(with_words) == sum(1 for _, n, _ in linked if not n)
    assert sum(x.doc_id == 3 for x in kept) == 1  # the repeated row stays once


def test_mixing(spark, odd_rows):
    df = frame(spark, odd_rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(odd_rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=str)
    by = {}
    for x in got:
        assert 0 <= x.taken <= 3 * x.size
        by.setdefault(x.source, []).append(x)
    total = sum(x.size for x in got)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    for rows in by.values():
        assert sum(x.size for x in rows) == rows[0].source_size and rows[0].target <= 3 * rows[0].source_size
        assert abs(sum(x.taken for x in rows) - rows[0].target) <= 1
    kept = mixing.take_mix(df)
    assert kept.columns.count("size") == 1 and {x.taken for x in kept.collect()} > set() and kept.where("taken <= 0").count() == 0


def test_mixing_shares_a_budget_over_repeated_rows(spark):
    rows = [(1, "a b c d", "en", "x")] * 50 + [(2, "e " * 100, "en", "y")] + [(3, "f " * 7, "en", "z")]
    got = mixing.mix(frame(spark, rows)).collect()
    for s in "xyz":
        mine = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= 1
    many = [(1, "a", "en", "x")] * 1000 + [(2, "b " * 150, "en", "y"), (3, "c " * 150, "en", None)]
    for docs in (frame(spark, many), frame(spark, many).repartition(7)):
        got = mixing.mix(docs).collect()
        for s in ("x", "y", None):
            mine = [x for x in got if x.source == s]
            assert abs(sum(x.taken for x in mine) - mine[0].target) <= 1 and all(x.taken <= 3 * x.size for x in mine)
        assert sum(x.taken for x in got if x.source == "x") == 400


def test_mixing_with_columns_of_its_own_names(spark):
    rows = [(1, "a", "en", "x")] * 90 + [(2, "b " * 30, "en", "y"), (3, None, "en", "z")]
    docs = frame(spark, rows).selectExpr("*", "1 wanted", "2 tied", "3 repeats", "4 threshold", "5 rest", "6 bucket", "7 number", "8 part", "9 source_size", "10 row", "11 budget")
    kept = mixing.take_mix(docs)
    assert set(docs.columns) | {"taken", "source_size"} == set(kept.columns) | {"hash"}
    assert {(x.wanted, x.tied, x.repeats, x.threshold, x.rest, x.bucket, x.number, x.part, x.row, x.budget) for x in kept.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8, 10, 11)}
    taken = {s: sum(x.taken for x in kept.collect() if x.source == s) for s in "xy"}
    assert sum(taken.values()) == 120 and taken["x"] == 40


def test_language_paths_are_the_best():
    r = np.random.default_rng(0)
    scores = -r.integers(0, 6, size=(60, 3)).astype(np.float32)
    first, last = np.array([0, 20, 27, 27]), np.array([20, 27, 27, 60])
    got = langid.viterbi(scores, first, last)

    def value(path, s):
        return sum(s[k, p] for k, p in enumerate(path)) - langid.SWITCH * sum(a != b for a, b in itertools.pairwise(path))

    best = max(value(p, scores[20:27]) for p in itertools.product(range(3), repeat=7))
    assert value(got[20:27], scores[20:27]) == best
    for a, b in ((0, 20), (27, 60)):
        v = scores[a].astype(float)
        for k in range(a + 1, b):
            v = np.maximum(v, v.max() - langid.SWITCH) + scores[k]
        assert value(got[a:b], scores[a:b]) == v.max()


def test_language_shortcut_agrees_with_the_search(spark):
    en, fr = "the of and water house river stone".split(), "le de et maison fleuve pierre eau".split()
    r = random.Random(2)
    train = [(k, " ".join(r.choice(en if k % 2 else fr) for _ in range(40)), "en" if k % 2 else "fr", "a") for k in range(60)]
    model = langid.train(frame(spark, train))
    texts = [" ".join([*(r.choice(en) for _ in range(r.randint(0, 20))), *(r.choice(fr) for _ in range(r.randint(0, 20)))]) for _ in range(50)]
    t = langid._Letters(texts)
    labels, _ = langid.label(model, t)
    scores = model.score(t)
    found = langid.viterbi(scores, t.first[:-1], t.first[1:])
    for a, b in zip(t.first[:-1], t.first[1:], strict=True):
        def value(p, a=a):
            return sum(scores[a + k, x] for k, x in enumerate(p)) - langid.SWITCH * sum(x != y for x, y in itertools.pairwise(p))
        assert abs(value(labels[a:b]) - value(found[a:b])) < 1e-4
    rows = [(1, "the river and the stone house of water", None, None), (2, "le fleuve et la maison de pierre", None, None), (3, None, "en", "a"), (4, "123 ... !!", "en", "a"), (5, "", None, None)]
    mixed = "the river of stone and water house the river " * 3 + "maison de pierre et eau le fleuve de " * 2
    got = {x.doc_id: x for x in langid.identify(frame(spark, [*rows, (6, mixed, None, None)]), model).collect()}
    assert [got[k].lang_pred for k in range(1, 6)] == ["en", "fr", "und", "und", "und"]
    assert got[3].score == 0 and 0 < got[1].score <= 1 and got[3].spans == []
    assert [x.lang for x in got[6].spans] == ["en", "fr"] and mixed[got[6].spans[1].start :].startswith("maison")
    assert langid.keep_identified(frame(spark, rows), model, 0.2).count() == 2
    none = langid.train(frame(spark, train).where("false"))
    assert {x.lang_pred for x in langid.identify(frame(spark, rows), none).collect()} == {"und"}


@pytest.mark.parametrize("n_langs", [3, 4, 5, 6])
def test_language_shortcut_never_overrides_the_search(n_langs):
    """Random scores, stretches of several languages in the middle and at both ends: what label() finds is worth what the search finds."""
    rng = np.random.default_rng(n_langs)
    n_docs, worth = 2500, []
    sizes = rng.integers(0, 30, n_docs)
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = -np.minimum(rng.exponential(rng.choice([0.5, 2.0, 4.0], (first[-1], 1)), (first[-1], n_langs)), langid.CLIP)
    favoured = np.repeat(rng.integers(0, n_langs, first[-1] // 4 + 1), 4)[: first[-1]]
    scores[np.arange(first[-1]), favoured] *= rng.choice([0.0, 1.0], first[-1])
    # Two stretches against a language that is second best everywhere.
    scores[first[7] : first[8]], scores[first[8] : first[9]] = 0, 0
    scores = (scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
    case = np.array([[-1, 0, -5] + [-5] * (n_langs - 3)] * 8 + [[-1, -5, 0] + [-5] * (n_langs - 3)] * 8, dtype=np.float32)
    scores, first = np.concatenate([scores, case, case[:, ::-1]]), np.concatenate([first, [first[-1] + 16, first[-1] + 32]])
    t = types.SimpleNamespace(first=first, offsets=np.zeros(len(first)))
    labels, _ = langid.label(types.SimpleNamespace(langs=list(range(n_langs)), score=lambda t: scores), t)
    found = langid.viterbi(scores, first[:-1], first[1:])
    for a, b in itertools.pairwise(first.tolist()):
        own, best = (float(scores[np.arange(a, b), x[a:b]].sum()) - langid.SWITCH * int((np.diff(x[a:b]) != 0).sum()) for x in (labels.astype(int), found.astype(int)))
        assert abs(own - best) < 1e-3
        worth.append(len(set(found[a:b].tolist())))
    assert max(worth) > 1 and worth[-2:] == [2, 2]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out()).collect()
    assert sum(x.lang == x.lang_pred for x in out) >= 0.97 * len(out)


def test_unknown_scripts_count_against_the_score(spark):
    train = [(k, "the river and the stone house of water" if k % 2 else "le fleuve et la maison de pierre", "en" if k % 2 else "fr", "a") for k in range(40)]
    model = langid.train(frame(spark, train))
    rows = [(1, "Вот дом у реки и большой камень в воде " * 5, "x", "a"), (2, "το σπίτι και το νερό του ποταμού " * 5, "x", "a"), (3, "我们 的 房子 在 河边 " * 5, "x", "a"), (4, "the river and the stone house вот дом", "x", "a"), (5, "the river and the stone house", "x", "a")]
    got = {x.doc_id: x for x in langid.identify(frame(spark, rows), model).collect()}
    assert [got[k].score for k in (1, 2, 3)] == [0, 0, 0] and {got[k].lang_pred for k in (1, 2, 3)} <= {"en", "fr"}
    assert 0.5 < got[4].score <= 0.75 < got[5].score
    assert {x.doc_id for x in langid.keep_identified(frame(spark, rows), model, 0.2).collect()} == {4, 5}


def test_odd_texts_of_every_script(spark):
    rows = [(1, "Привет мир", "ru", "a"), (2, "日本語のテキスト", "ja", "a"), (3, "İstanbul ǅ ﬁ ́", "tr", "a"), (4, "a" * 300_000, "en", "a"), (5, "x " * 100_000, "en", "a")]
    model = langid.train(frame(spark, rows))
    got = {x.doc_id: x.lang_pred for x in langid.identify(frame(spark, rows), model).collect()}
    assert got[1] == "ru" and got[2] == "ja"


ITEM = "Anna has 12 apples and gives 5 apples to her friend before walking 3 km to the old market in town"


def test_leaks(spark):
    other = "Filler words stand here. Peter has 40 apples and gives 7 apples to her friend before walking 9 miles to the old market in town. More."
    crossed = ITEM.replace("5 apples", "12 pears")[:60]  # too little of it
    docs = [
        (1, "Some text. " + ITEM + ". Other text.", "en", "a"), (2, other, "en", "a"), (3, ITEM.upper() + "!", "en", "a"), (4, "Nothing of the kind is to be found here, just a few words more than needed", "en", "a"),
        (5, None, None, None), (6, "", "en", "a"), (None, ITEM, "en", "a"), (7, " ".join(ITEM.split()[:9]), "en", "a"), (8, crossed, "en", "a"),
    ]
    bench = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, None), (12, ""), (13, "two words"), (14, "Completely different words that never occur in any of these documents at all, says nobody ever")], "item_id long, text string")
    got = decontaminate.find_leaks(frame(spark, docs), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(1, 10), (2, 10), (3, 10), (None, 10)}
    assert {x.doc_id: x.exact for x in got}[1] and not {x.doc_id: x.exact for x in got}[2]
    assert {x.doc_id for x in decontaminate.drop_leaks(frame(spark, docs), bench).collect()} == {4, 5, 6, 7, 8}
    assert decontaminate.find_leaks(frame(spark, docs), bench.where("false")).count() == 0


def test_slots_have_to_be_consistent(spark):
    item = "if x1 equals 4 then adding 4 to the value of the box and doubling the value of the result gives what"
    good, bad = item.replace("4", "9"), item.replace("4", "9", 1).replace("adding 4", "adding 7")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.find_leaks(frame(spark, [(1, good, "en", "a"), (2, bad, "en", "a")]), bench).collect()
    assert [x.doc_id for x in got] == [1]


def test_parts_of_runs_are_leaks(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()
    kept = f"take 2 {' '.join(words)} then 2 more of omega"
    sums = "What is 12 + 45 + 33 + 18 + 27 + 64 + 91 + 5 ?"
    others = " ".join(x[::-1] for x in words)
    pair = f"first 7 and 7 {others} and 3 of rho"
    bench = spark.createDataFrame([(1, sums), (2, kept), (3, pair)], "item_id long, text string")
    docs = [
        (1, "see: " + sums, "en", "a"), (2, sums.replace("45", "46"), "en", "a"), (3, kept.replace("then 2", "then 3"), "en", "a"),
        (4, f"first 8 and 8 {others} and 8 of rho", "en", "a"), (5, pair.replace("7", "4"), "en", "a"),
    ]
    got = {(x.doc_id, x.item_id): (x.matched, x.exact) for x in decontaminate.find_leaks(frame(spark, docs), bench).collect()}
    assert got == {(1, 1): (10, True), (3, 2): (16, True), (4, 3): (18, False), (5, 3): (21, False)}


def test_judging_runs_against_all_parts():
    r = np.random.default_rng(3)
    for _ in range(400):
        n, need = int(r.integers(3, 16)), int(r.integers(2, 6))
        at = np.flatnonzero(r.random(n) < r.random())
        item, doc = r.integers(0, 3, len(at)), r.integers(0, 3, len(at))

        def accepted(a, b, plain=True):
            inside = [(i, d) for p, i, d in zip(at, item, doc, strict=True) if a <= p < b]
            pairs = set(inside)
            consistent = len(pairs) == len({i for i, _ in pairs}) == len({d for _, d in pairs})
            exact = all(i == d for i, d in inside)
            return consistent and (exact or not plain or 2 * len(inside) <= b - a), exact, len(inside), any(i == d for i, d in inside)

        whole = accepted(0, n, plain=False)[0]
        best = None
        for a, b in itertools.combinations(range(n + 1), 2):
            ok, exact, slots, same = accepted(a, b)
            if b - a >= need and ok and (whole or same or slots > 1):
                best = max(best or (0, False), (b - a, exact))
        assert decontaminate.judge(n, need, at, item, doc) == best


def test_leaks_whatever_the_form_of_tokens(spark):
    cart = "a cart of 5kg goes 30km from 10am on and then comes back with the other half of it"
    names = "Then Ann saw Bob near Carl and Dora told Emil that Fay and Gus met Hal at Ida or Jon by Kim"
    capital = "What is the capital of France"
    bench = spark.createDataFrame([(1, cart), (2, names), (3, capital)], "item_id long, text string")
    docs = [
        (1, "x " + cart.replace("5kg", "7 kg").replace("30km", "40km").replace("10am", "11-am"), "en", "a"), (2, "so: " + names.lower(), "en", "a"), (3, names.upper(), "en", "a"),
        (4, "(a) What is the capital of France", "en", "a"), (5, "(a) What is the capital of Spain", "en", "a"), (6, "it is the capital of a bank", "en", "a"),
    ]
    got = {(x.doc_id, x.item_id): x.exact for x in decontaminate.find_leaks(frame(spark, docs), bench).collect()}
    assert got == {(1, 1): False, (2, 2): True, (3, 2): True, (4, 3): True, (5, 3): False}


def test_leaks_of_numbers_and_of_short_items(spark):
    r = random.Random(6)
    numbers = lambda n: " ".join(str(r.randint(10, 99)) for _ in range(n))
    table, sums = numbers(20_000), [f"add up {numbers(30)}" for _ in range(20)]
    bench = spark.createDataFrame([*enumerate(sums), (50, "yes"), (51, "yes or no then"), (52, "7 " * 30)], "item_id long, text string")
    docs = [(1, table, "en", "a"), (2, f"{table} {sums[3]} {table}", "en", "a"), (3, "yes or no then 5 6", "en", "a"), (4, "8 " * 20_000, "en", "a"), (5, sums[4].replace(" ", "  +  "), "en", "a")]
    windows = decontaminate.template_windows(bench, "item_id").distinct()
    hashes = np.sort(windows.select("hash").distinct().toPandas()["hash"].to_numpy().view(np.uint64))
    assert decontaminate.template_windows(frame(spark, docs), "doc_id", (hashes, (7, 8))).join(windows.select("size", "hash"), ["size", "hash"]).count() < 200
    assert {(x.doc_id, x.item_id, x.exact) for x in decontaminate.find_leaks(frame(spark, docs), bench).collect()} == {(2, 3, True), (5, 4, True)}


def test_leaks_of_a_benchmark_beyond_the_lookup(spark, monkeypatch):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = frame(spark, [(1, "x " + ITEM.replace("12", "70"), "en", "a"), (2, "nothing of it here at all, not one word", "en", "a")])
    monkeypatch.setattr(decontaminate, "LOOKUP", 0)
    assert [(x.doc_id, x.exact) for x in decontaminate.find_leaks(docs, bench).collect()] == [(1, False)]


def test_windows_take_little_memory():
    r = random.Random(3)
    texts = [" ".join(r.choice(["river", "House", "12", "kg", "stone,"]) for _ in range(400)).encode() for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(range(1500), pa.int64()), pa.array(texts, pa.binary())], names=["id", "row_hash", "text"])
    assert batch["text"].nbytes > 2 << 20
    tracemalloc.start()
    for _ in decontaminate._windows(iter([batch]), (np.zeros(1, dtype=np.uint64), (8,))):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20  # a worker's share of an executor's memory; all of the batch would take several times as much


def test_recall_of_changed_items(spark):
    r = random.Random(12)
    words = "river house stone water market garden window letter bridge summer winter doctor teacher driver farmer yellow silver simple heavy quick".split()
    names = "Anna Peter Maria Jonas Clara Oskar Nina Paul Ella Max".split()

    def template():
        parts = [r.choice(words) for _ in range(r.randint(18, 40))]
        for k in range(2, len(parts) - 1, r.randint(4, 6)):
            parts[k] = r.choice(["{n}", "{n} kg", "{a}"])
        return "The " + " ".join(parts)

    def fill(t):
        low, who = r.randint(2, 900), r.choice(names)
        return t.replace("{n}", str(low)).replace("{a}", who).replace(" kg", r.choice([" kg", " km", " hours"]))

    templates = [template() for _ in range(150)]
    other = lambda: " ".join(r.choice(words) for _ in range(40))
    bench = spark.createDataFrame(list(enumerate(map(fill, templates))), "item_id long, text string")
    docs = [(k, f"{other()}. {fill(t)}. {other()}", "en", "a") for k, t in enumerate(templates)] + [(1000 + k, ". ".join(other() for _ in range(4)), "en", "a") for k in range(300)]
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(frame(spark, docs), bench).collect()}
    right = {(k, k) for k in range(len(templates))}
    assert len(got & right) >= 0.9 * len(right) and len(got - right) <= 0.02 * len(got)


def test_leaks_against_plain_search(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(re.sub(r"[^\w]+", " ", t or "").lower().split())
    items = {x.item_id: plain(x.text) for x in bench.collect()}
    expected = {(x.doc_id, i) for x in docs.collect() for i, t in items.items() if t in plain(x.text)}
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench).collect()}
    assert expected and got == expected


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    lines = mit.replace("sublicense, ", "sublicense,\n").replace("conditions: ", "conditions:\n")
    rows = [(1, "Many other words stand here before it.\nLicensed under CC BY-NC 4.0.\n\nMore words here", "en", "a"), (2, lines, "en", "a"), (3, None, None, None), (4, "", "en", "a"), (5, "word", "en", "a"), (6, "nothing of that kind " * 20_000, "en", "a"), (7, "ALL rights, reserved", "en", "a")]
    got = licenses.scan(frame(spark, rows)).collect()
    assert {(x.doc_id, x.unit, x.license, x.first_word) for x in got} == {(1, "line", "CC-BY-NC-4.0", 7), (2, "paragraph", "MIT-text", 0), (7, "line", "proprietary", 0)}
    assert all(x.dice == 1.0 for x in got)
    assert licenses.scan(frame(spark, []), least=0.9).count() == 0


def test_license_versions_and_altered_texts(spark):
    r = random.Random(3)
    names = ["AGPL-3.0-notice", "GPL-2.0-notice", "GPL-3.0-notice-full", "LGPL-2.1-notice", "LGPL-3.0-notice", "BSD-2-Clause-full", "BSD-3-Clause-full", "MIT-full", "ISC-full", "Zlib"]
    prose = lambda n: " ".join(r.choice("river house stone water market garden window letter".split()) for _ in range(n))

    def altered(text):
        words = text.split()
        for _ in range(len(words) // 30):
            words[r.randrange(len(words))] = "WORD"
        cut = sorted(r.sample(range(5, len(words) - 5), 3))
        return "\n\n".join(" ".join(words[a:b]) for a, b in zip([0, *cut], [*cut, len(words)], strict=True))

    rows = [(k, f"{prose(30)}\n\n{altered(licenses.TEMPLATES[n])}\n\n{prose(40)}", "en", "a") for k, n in enumerate(names * 3)]
    best = {}
    for x in licenses.scan(frame(spark, rows)).collect():
        if x.dice > best.get(x.doc_id, (0, ""))[0]:
            best[x.doc_id] = (x.dice, x.license)
    assert sum(best.get(k, (0, ""))[1] == names[k % len(names)] for k in range(len(rows))) >= 0.9 * len(rows)
    assert licenses.scan(frame(spark, [(1, prose(3000), "en", "a")])).count() == 0
    for n in range(3, 11):  # fewer paragraphs than a run has, and more
        parts = [prose(3)] * n
        parts[n // 2 : n // 2 + 2] = ["Licensed under the Apache License,", "Version 2.0."]
        got = licenses.scan(frame(spark, [(1, "\n\n".join(parts), "en", "a")]).coalesce(1)).collect()
        assert ("run", "Apache-2.0", 8, 1.0) in {(x.unit, x.license, x.n_words, x.dice) for x in got}, n


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(x.lstrip("0") or 0) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                s = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or s % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(BASE).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def test_personal_data(spark):
    r = random.Random(1)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (234) 555-6789", "+12", "é", " ", ".", "-", "7", "token = 0123456789abcdef0123456789abcdef", "write to joe at mail dot com", "(234) 555-6789"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 25))), "en", "a") for k in range(400)]
    rows += [(900, None, None, None), (901, "", None, None), (902, "9" * 50_000, "en", "a"), (903, "a" * 50_000 + "@", "en", "a"), (None, "a@b.cc", "en", "a"), (903, "0" * 6000 + ".1.1.1", "en", "a")]
    docs = frame(spark, rows)
    model = pii.train(docs)
    for x, (i, t, *_) in zip(pii.find(docs.coalesce(1), model).collect(), rows, strict=True):
        base = [b[2] for b in brute_base(t)]
        assert x.doc_id == i and x.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(b.startswith(k) for b in base) for k in BASE]
        assert set(base) <= set(x.spans.split(",")) | {""} and len([s for s in x.spans.split(",") if s]) == len(base) + x.n_added
    masked = {x.doc_id: x.text for x in pii.redact(docs, model).collect()}
    assert masked[None] == "[EMAIL]" and masked[900] is None and masked[901] == ""
    assert pii.redact(docs, model).columns == docs.columns and pii.find(docs.where("false"), pii.train(docs.where("false"))).count() == 0


def test_loose_spans_in_linear_time():
    text = " ".join(f"4111 1111 1111 1{k % 1000:03d}." for k in range(20_000))
    began = time.process_time()
    spans = pii.candidates(text)
    assert len(spans) > 15_000 and time.process_time() - began < 5
    covered = sorted(x[1:3] for x in spans)
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(covered))


def test_added_spans(spark):
    r = random.Random(4)
    words = "the river house of stone and water where people meet in summer".split()
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    planted = {
        "secret": lambda: r.choice([f"token = {hexes(40)}", f"api_key: AKIA{''.join(r.choice('ABCDEFGHIJKLMNOP234567') for _ in range(16))}", f"key ghp_{hexes(36)}"]),
        "email": lambda: f"write to {r.choice(['ann', 'joe.b'])} {r.choice(['(at)', '[at]'])} mail{r.randint(1, 9)}{r.choice(['.', ' (dot) '])}com",
        "phone": lambda: f"call ({r.randint(200, 989)}) {r.randint(200, 989)}-{r.randint(1000, 9999)}",
        "iban": lambda: "iban DE89 3704 0044 0532 0130 00",
        "national": lambda: f"ssn {r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
    }
    filler = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, kinds = [], {}
    for k in range(300):
        kind = r.choice(list(planted)) if k % 2 else None
        kinds[k] = kind
        rows.append((k, f"{filler(15)} {planted[kind]() if kind else f'in {r.randint(1000, 2100)} about {r.randint(1, 99)}.{r.randint(0, 9)} and 12-34-567'} {filler(15)}", "en", "a"))
    rows += [(900, "key sk-abcdefghijKLMNOPQRSTuvwx for it", "en", "a"), (901, f"token {'abcdef' * 7} ok", "en", "a")]
    docs = frame(spark, rows)
    model = pii.train(docs)
    got = {x.doc_id: x for x in pii.find(docs, model).collect()}
    hits = [k for k, kind in kinds.items() if kind and got[k][f"added_{kind}"] > 0]
    assert len(hits) >= 0.9 * sum(x is not None for x in kinds.values())
    assert sum(got[k].n_spans > 0 for k, kind in kinds.items() if kind is None) == 0
    masked = {x.doc_id: x.text for x in pii.redact(docs.withColumn("maybe", F.lit(1)), model).collect()}
    assert all((got[k].masked or t) == masked[k] for k, t, *_ in rows) and "[SECRET]" in masked[900]


def test_em_finds_reliable_labelers():
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.5
    good = np.where(truth, 1, -1)
    noise = r.choice([-1, 0, 1], size=4000)
    rows = np.stack([np.zeros(4000, dtype=int), good, np.where(r.random(4000) < 0.9, good, -good), np.where(truth & (r.random(4000) < 0.5), 1, 0), noise, np.where(r.random(4000) < 0.8, good, 0), *np.zeros((4, 4000), dtype=int)], axis=1)
    kinds, n = np.unique(rows, axis=0, return_counts=True)
    m = pii.fit(kinds, n.astype(float))
    assert m.reliabilities[0, 1, 2] > 0.95 and abs(m.reliabilities[3, 1, 2] - m.reliabilities[3, 0, 2]) < 0.1
    assert ((m.probability(rows) > 0.5) == truth).mean() > 0.98


def test_media_round_trip(spark, odd_rows):
    r = random.Random(9)
    shared = "".join(chr(r.randint(32, 0x2FF)) for _ in range(5000))
    rows = odd_rows + [(200 + k, shared[k * 7 :] + str(k), "en", "a") for k in range(6)] + [(300, "a" * 70_000, "en", "a")]
    stored = media.store(frame(spark, rows).repartition(4))
    got = media.read_back(stored).collect()
    expected = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        w = media.header(len(p)) + p
        expected.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(w), hashlib.sha256(w).hexdigest(), media.features(np.frombuffer(p, dtype=np.uint8))))
    assert order(map(tuple, got)) == order(expected)
    kept = sum(len(c["bytes"]) for x in stored.dropDuplicates(["row_key"]).collect() for c in x.own)
    assert kept < 0.75 * sum(x[2] for x in expected)  # shared chunks are stored once
    assert media.read_back(media.store(frame(spark, []))).count() == 0


def test_texts_without_shared_chunks_stay_where_they_are(spark, odd_rows, monkeypatch):
    rows = odd_rows + [(400 + k, hashlib.sha256(str(k).encode()).hexdigest() * 40, "en", "a") for k in range(30)]
    docs = frame(spark, rows).repartition(4)
    expected = order(map(tuple, media.read_back(media.store(docs)).collect()))
    joined = []

    def counted(column):
        joined.append(column)
        return column

    found = media.may_be_among
    monkeypatch.setattr(media, "is_small", lambda df: False)
    monkeypatch.setattr(media, "maybe_broadcast", lambda df: df)
    monkeypatch.setattr(media, "may_be_among", lambda marks: counted(found(marks)))
    for cells in (1 << 28, 8):  # a full bitmap sends all texts, and nothing else changes
        monkeypatch.setattr(media, "CELLS", cells)
        assert order(map(tuple, media.read_back(media.store(docs)).collect())) == expected
    keys = spark.range(1000).select(F.xxhash64("id").alias("row_key"), "id")
    monkeypatch.setattr(media, "CELLS", 1 << 28)
    may = keys.withColumn("may", found(keys.where("id < 100").select("row_key"))).where("may")
    assert len(joined) == 2 and may.where("id < 100").count() == 100 and may.count() < 300


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substrings.remove_repeats(none).count() == 0 and jaccard.link(none).count() == 0 and mixing.mix(none).count() == 0
    assert jaccard.keep_one(none).count() == 0 and mixing.take_mix(none).count() == 0

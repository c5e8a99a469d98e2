"""Batches of alignments against the kernel for one pair, and the scorer of doculects against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from glossarium.functions import align as al
from glossarium.functions import sounds
from glossarium.functions.batches import align_all
from glossarium.operators import cognates as cg
from glossarium.operators import lexstat as ls
from glossarium.operators import linkage as lk

FORMS = ["tak", "taxtər", "doːtər", "tʰoxtər", "fiʎa", "fij", "hant", "hand", "mano", "mɛ̃", "nox nox", "a", "ta⁵⁵", "ma²¹ta³", "vatər", "pater", "per", "strand"]


@pytest.mark.parametrize("mode", ["global", "overlap", "local"])
def test_batches_align_as_single_pairs(mode):
    rng = np.random.default_rng(5)
    for _ in range(20):
        size, n, m = 30, 6, 5
        a, b = rng.integers(1, n + 1, size), rng.integers(1, m + 1, size)
        scores, gap_a, gap_b = rng.integers(-3, 4, (size, n, m)).astype(float), -rng.integers(1, 3, (size, n)).astype(float), -rng.integers(1, 3, (size, m)).astype(float)
        score, columns = align_all(scores, a, b, gap_a, gap_b, mode, 0.5)
        places = columns()
        for k in range(size):
            want, best = al.align(scores[k, : a[k], : b[k]], gap_a[k, : a[k]], gap_b[k, : b[k]], mode, 0.5)
            got = [(int(i), int(j)) for i, j in zip(places[0][k], places[1][k]) if i > -2][::-1]
            assert (got, score[k]) == (want, best)


def test_distances_in_batches_are_those_of_single_pairs():
    a, b = (pd.Series(x) for x in zip(*[(x, y) for x in FORMS for y in FORMS]))
    split = {f: ls.segmented(f) for f in FORMS}
    assert np.allclose(ls.class_distances(a, b), [cg.sca_distance(split[x], split[y]) for x, y in zip(a, b)])
    assert np.allclose(ls.edit_distances(a, b), [cg.edit_distance(split[x], split[y]) for x, y in zip(a, b)])
    assert ls.class_distances(pd.Series(["", "ta"]), pd.Series(["ta", ""])).tolist() == [1.0, 1.0]


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(1)
    rows, k = [], 0
    for c in range(40):
        for d in "ABC":
            for _ in range(rng.choice([0, 1, 1, 2])):
                rows.append((k := k + 1, d, f"c{c}", rng.choice(FORMS), "x"))
    rows.append((k + 1, "A", "c0", None, "x"))
    return spark.createDataFrame(rows, "id long, doculect string, concept string, form string, cogid string")


def aligned(x, y, mode, gop, scale):
    """Symbols that meet, and the distance, by the kernel for one pair."""
    (p, pro_p), (q, pro_q) = ls.symbols(x), ls.symbols(y)
    score = lambda s, t: ls.class_score(s[0], t[0])
    xs, ys, _, d = al.align_pair(p, q, score, gop, scale, mode, sounds.gap_weights(pro_p), sounds.gap_weights(pro_q), pro_p, pro_q, ls.FACTOR, ls.RESTRICTED)
    return list(zip(xs, ys)), d


def test_scorer_is_that_of_counting(words):
    rows = [r for r in words.collect() if r.form]
    dealt = [tuple(r) for r in ls.dealt_pairs(words, 200, 3).collect()]
    assert {(a, b): sum(r[4] for r in dealt if r[:2] == (a, b)) for a in "ABC" for b in "ABC" if a <= b} == {(a, b): 200 for a in "ABC" for b in "ABC" if a <= b}
    real = {(x.doculect, y.doculect, x.form, y.form) for x in rows for y in rows if x.concept == y.concept and x.doculect < y.doculect}
    real |= {(x.doculect, x.doculect, x.form, x.form) for x in rows}
    attested, expected, included, drawn = Counter(), Counter(), Counter(), Counter()
    for number, (mode, gop, scale) in enumerate(ls.MODES):
        for a, b, x, y in real:
            met, d = aligned(x, y, mode, gop, scale)
            if d <= 0.7:
                attested.update((a, b, *c) for c in met)
                included[a, b] += number
        for a, b, x, y, times in dealt:
            for c in aligned(x, y, mode, gop, scale)[0]:
                expected[(a, b, *c)] += times
            drawn[a, b] += number * times
    got = {(r.a, r.b, r.x, r.y): r.score for r in ls.scorer(words, seed=3, runs=200).collect()}
    alphabet = {d: {s for r in rows if r.doculect == d for s in ls.symbols(r.form)[0]} | {"-"} for d in "ABC"}
    assert set(got) == {(a, b, x, y) for a in "ABC" for b in "ABC" if a <= b for x in alphabet[a] for y in alphabet[b]}
    for (a, b, x, y), score in got.items():
        n, e = attested[a, b, x, y] / 2, expected[a, b, x, y] / 2 * included[a, b] / drawn[a, b]
        n = 0 if a != b and n <= 1 else n
        odds = math.log2(n * n / (e * e)) if n and e else math.log2(n * n / 1e-5) if n else -5 if e else -90
        base = -1.5 if "-" in (x, y) else ls.class_score(x[0], y[0])
        assert score == pytest.approx((2 * odds + base) / 3)


def test_distances_and_clusters_by_the_scorer(spark, words):
    scores = ls.scorer(words, seed=3, runs=200)
    table = {(r.a, r.b, r.x, r.y): r.score for r in scores.collect()}
    pairs = ls.attested_pairs(words)
    found = ls.distances(pairs, scores).collect()
    assert len(found) == pairs.count()
    for r in found:
        (p, pro_p), (q, pro_q) = ls.symbols(r.entry_a), ls.symbols(r.entry_b)
        s = al.score_matrix(p, q, lambda x, y: table[r.a, r.b, x, y], pro_p, pro_q, ls.FACTOR, ls.RESTRICTED)
        gaps = [2 * table[r.a, r.a, "-", x] for x in p], [2 * table[r.b, r.b, "-", y] for y in q]
        _, best = al.align(s, *gaps, "overlap", 0.5)
        own = (sum(table[r.a, r.a, x, x] for x in p) + sum(table[r.b, r.b, y, y] for y in q)) * 1.3
        assert r.distance == pytest.approx(1 - 2 * best / own)
    got = ls.cluster(words, scores).collect()
    assert len(got) == words.count() and all(r.lexstatid.startswith(f"{r.concept}:") for r in got if r.form)
    same = {}
    for r in got:
        if r.form:
            same.setdefault((r.concept, r.doculect, r.form), set()).add(r.lexstatid)
    assert all(len(x) == 1 for x in same.values())


def test_no_words(words):
    none = words.limit(0)
    assert ls.scorer(none, runs=5).count() == 0
    assert ls.distances(ls.attested_pairs(none), ls.scorer(none, runs=5)).count() == 0


def test_pairs_of_forms_come_from_one_reading(spark, words):
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    watched = words.mapInPandas(watch, words.schema)
    ls.scorer(watched, seed=3, runs=200).collect()
    assert seen.value <= 5 * words.count()


@pytest.mark.parametrize("tile", [1, 3, 512])
def test_pairs_of_keys_are_those_of_a_join(spark, words, tile, monkeypatch):
    monkeypatch.setattr(lk, "TILE", tile)
    own = {}
    for r in words.collect():
        own.setdefault(r.concept, set()).update([(r.doculect, r.form)] if r.form else [])
    want = sorted((*x, *y) for x, y in {(x, y) for c in own.values() for x in c for y in c if x[0] < y[0]})
    got = [(r.a, r.entry_a, r.b, r.entry_b) for r in ls.attested_pairs(words).where("a < b").collect()]
    assert sorted(got) == want
    items = spark.createDataFrame([("x", 0, 4), ("x", 0, 2), ("x", 0, 2), ("x", 1, 7), ("y", 2, 4), ("y", 2, 2), ("z", 2, 9), ("z", 2, 4)], "bin string, block int, key int")
    pairs = lambda *a: sorted(tuple(r) for r in lk.key_pairs(items, *a).collect())
    assert pairs() == [(2, 4), (2, 9), (4, 9)] and pairs(True, ("bin",)) == [("x", 2, 2), ("x", 2, 4), ("x", 4, 4), ("x", 7, 7), ("y", 2, 2), ("y", 2, 4), ("y", 4, 4), ("z", 4, 4), ("z", 4, 9), ("z", 9, 9)]


def test_distances_are_dealt_out_however_short_their_rows(spark, words):
    scores = ls.scorer(words, seed=3, runs=20)
    assert ls.distances(ls.attested_pairs(words), scores).rdd.getNumPartitions() >= 4


def test_clusters_need_no_table_of_the_pairs_of_all_concepts(spark, monkeypatch):
    rows = [(c * 100 + k, "ABC"[k % 3], f"c{c}", FORMS[k // 3], "x") for c in range(40) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, doculect string, concept string, form string, cogid string")
    scores = spark.createDataFrame(ls.scorer(df, seed=3, runs=20).collect())
    counts = []
    for m in (ls, lk):

        def keep(t, f=m.kept):
            counts.append((out := f(t)).count())
            return out

        monkeypatch.setattr(m, "kept", keep)
    got = ls.cluster(df, scores).collect()
    # 30 forms are 435 pairs, which 40 concepts share
    assert max(counts) <= 1200 and len(got) == 1200
    assert len({tuple(sorted(r.lexstatid.split(":")[1] for r in got if r.concept == f"c{c}")) for c in range(40)}) == 1

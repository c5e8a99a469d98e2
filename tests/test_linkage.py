"""Clusters by rounds over tables of pairs, against dense matrices and brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossarium.functions import clusters as kernels
from glossarium.functions import strings as st
from glossarium.operators import cognates as cg
from glossarium.operators import linkage as lk


def matrices(seed, values=None, blocks=4):
    """Blocks of symmetric matrices, and their pairs; with values, many distances are equal."""
    rng = random.Random(seed)
    out, rows = {}, []
    for block in map(str, range(blocks)):
        n = rng.randint(2, 14)
        d = np.zeros((n, n))
        for i in range(n):
            for j in range(i + 1, n):
                d[i, j] = d[j, i] = rng.choice(values) if values else rng.random()
                rows.append((block, i, j, float(d[i, j])))
        out[block] = d
    return out, rows


def labels(found, mats):
    """The found roots of every block as a partition."""
    of = {b: list(range(len(d))) for b, d in mats.items()}
    for r in found.collect():
        of[r.block][r.node] = r.root
    return {b: partition(x) for b, x in of.items()}


def partition(roots):
    groups = {}
    for i, r in enumerate(roots):
        groups.setdefault(r, set()).add(i)
    return {frozenset(g) for g in groups.values()}


def greedy(d, method, threshold):
    """Roots by merging the nearest two clusters (ties by md5 of their least items) until none is near."""
    groups = {i: [i] for i in range(len(d))}
    measure = {"single": np.min, "average": np.mean, "complete": np.max}[method]
    while True:
        pairs = [(round(float(measure(d[np.ix_(x, y)])), 9), hashlib.md5(f"{i}|{j}".encode()).hexdigest(), i, j) for i, x in groups.items() for j, y in groups.items() if i < j]
        if not pairs or min(pairs)[0] > threshold:
            return [next(k for k, g in groups.items() if i in g) for i in range(len(d))]
        _, _, i, j = min(pairs)
        groups[i] += groups.pop(j)


SCHEMA = "block string, a int, b int, distance double"


@pytest.mark.parametrize("values", [None, [0.25, 0.5, 0.75], [0.5, 1.0]])
@pytest.mark.parametrize("method", ["single", "average", "complete"])
def test_linkage_is_that_of_merging_the_nearest_pair(spark, method, values):
    mats, rows = matrices(5, values)
    found = lk.linkage_clusters(spark.createDataFrame(rows, SCHEMA), 0.55, method)
    assert labels(found, mats) == {b: partition(greedy(d, method, 0.55)) for b, d in mats.items()}
    if values is None:
        assert labels(found, mats) == {b: partition(kernels.labels_of(len(d), kernels.agglomerate(d, method, 0.55))) for b, d in mats.items()}
    assert all(r.root <= r.node for r in found.collect())


def test_linkage_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    far = spark.createDataFrame([("x", 1, 2, 0.9), ("x", 1, 3, None)], SCHEMA)
    for method in ("upgma", "single", "complete", "dbscan", "mcl"):
        assert lk.flat_clusters(none, 0.5, method).count() == 0
        assert all(r.node == r.root for r in lk.flat_clusters(far, 0.5, method).collect())
    with pytest.raises(ValueError):
        lk.flat_clusters(far, 0.5, "other")
    with pytest.raises(ValueError):
        lk.linkage_clusters(far, 0.5, "median")


def test_pairs_without_a_distance_stay_apart(spark):
    rows = [("x", 1, 2, 0.1), ("x", 2, 3, 0.1), ("x", 1, 3, None)]
    for method in ("average", "complete"):
        found = lk.linkage_clusters(spark.createDataFrame(rows, SCHEMA), 0.5, method).collect()
        assert [r.node for r in found if r.node != r.root] in ([2], [3])


def watched(monkeypatch, *modules):
    """The numbers of rows of all tables that the modules write from now on."""
    rows = []
    for m in modules:

        def keep(df, f=m.kept):
            rows.append((out := f(df)).count())
            return out

        monkeypatch.setattr(m, "kept", keep)
    return rows


@pytest.mark.parametrize("method", ["upgma", "complete", "single"])
@pytest.mark.parametrize("limits", [{}, {"DENSE": 2}, {"MOST": 6}, {"MOST": 0}])
def test_clusters_of_items_are_those_of_their_pairs(spark, method, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(lk, name, value)
    rng = random.Random(8)
    items = [(f"b{b}", f"{k:02}", rng.randint(1, 9), rng.choice([None, None, "p", "q"])) for b in range(6) for k in range(rng.randint(1, 16))]
    d = {(i, j): rng.choice([0.0, 0.25, 0.5, 0.75, rng.random()]) if i < j else 0.0 for i in range(1, 10) for j in range(i, 10)}
    d[2, 5] = None
    del d[3, 4]
    pairs = []
    for b, x, k, p in items:
        for c, y, m, q in items:
            if b == c and x < y:
                pairs.append((b, x, y, None if p and p == q else d.get((min(k, m), max(k, m)))))
    want = lk.flat_clusters(spark.createDataFrame(pairs, "block string, a string, b string, distance double"), 0.55, method).collect()
    tables = [spark.createDataFrame(items, "block string, node string, key long, apart string"), spark.createDataFrame([(*k, v) for k, v in d.items()], "key_a long, key_b long, distance double")]
    shared = lambda rows: {(r.block, r.node): r.root for r in rows if sum((q.block, q.root) == (r.block, r.root) for q in rows) > 1}
    assert shared(lk.item_clusters(*tables, 0.55, method).collect()) == shared(want)
    assert lk.item_clusters(tables[0].limit(0), tables[1], 0.55, method).count() == 0


def test_a_mean_at_the_threshold_is_near_whatever_the_order_of_its_sum(spark):
    # 0.1 + 0.2 + 0.6 and 0.6 + 0.2 + 0.1 are not equal as doubles
    rows = [("x", 1, 2, 0.0), ("x", 1, 3, 0.0), ("x", 2, 3, 0.0), ("x", 1, 4, 0.1), ("x", 2, 4, 0.2), ("x", 3, 4, 0.6 + 1e-16)]
    found = lk.linkage_clusters(spark.createDataFrame(rows, SCHEMA), 0.3).collect()
    assert {r.node: r.root for r in found} == dict.fromkeys((1, 2, 3, 4), 1)
    assert kernels.merged_in_rounds(np.array([[0, 0.3 + 1e-12], [0.3 + 1e-12, 0]]), ["a", "b"], 0.3).tolist() == [0, 0]


@pytest.mark.parametrize("least", [1, 2, 4])
def test_density_clusters(spark, least):
    mats, rows = matrices(9)
    found = labels(lk.density_clusters(spark.createDataFrame(rows, SCHEMA), 0.3, least), mats)
    for block, d in mats.items():
        near = d <= 0.3
        cores = [i for i in range(len(d)) if near[i].sum() >= least]
        root = {i: i for i in range(len(d))}
        for _ in d:
            for i in cores:
                root[i] = min(root[j] for j in cores if near[i, j])
        for i in range(len(d)):
            if i not in cores and any(near[i, j] for j in cores):
                root[i] = root[min(j for j in cores if near[i, j])]
        assert found[block] == partition([root[i] for i in range(len(d))])


def test_flow_clusters_are_those_of_the_dense_matrix(spark):
    mats, rows = matrices(3)
    found = labels(lk.flow_clusters(spark.createDataFrame(rows, SCHEMA), 0.4), mats)
    for block, d in mats.items():
        m = np.where(d < 0.4, -np.log2((1 - d) ** 2), 0.0)
        np.fill_diagonal(m, 1.0)
        m = m / m.sum(axis=0)
        for _ in range(100):
            m = (m @ m) ** 2
            m = m / m.sum(axis=0)
        assert found[block] == partition([int(np.flatnonzero(m[:, j] > 1e-6)[0]) for j in range(len(d))])


def test_known_flow(spark):
    d = [(0, 1, 0.5), (0, 2, 0.67), (0, 3, 0.8), (0, 4, 0.2), (1, 2, 0.4), (1, 3, 0.7), (1, 4, 0.6), (2, 3, 0.8), (2, 4, 0.8), (3, 4, 0.3)]
    found = lk.flow_clusters(spark.createDataFrame([("x", *r) for r in d], SCHEMA), 0.5)
    assert labels(found, {"x": np.zeros((5, 5))})["x"] == {frozenset({0, 3, 4}), frozenset({1, 2})}


def test_clusters_of_words(spark):
    words = [(1, "A", "c", "t o x t ə r"), (2, "B", "c", "d ɔː t ə r"), (3, "C", "c", "f i j"), (4, "D", "c", "f i j"), (5, "A", "e", "t o x t ə r")]
    df = spark.createDataFrame(words, "id long, doculect string, concept string, form string")
    for linkage in ("upgma", "single", "complete", "mcl", "dbscan"):
        got = {r.id: r.clusterid for r in cg.cluster(df, "edit-dist", linkage, 0.7).collect()}
        assert got[1] == got[2] == "c:d ɔː t ə r" and got[3] == got[4] == "c:f i j" and got[5] == "e:t o x t ə r"


def test_loose_ids(spark):
    rows = [(1, "c", [5, 7]), (2, "c", [7, 9]), (3, "c", [9]), (4, "c", [4]), (5, "c", []), (6, "d", [9, 5]), (7, "d", [1])]
    df = spark.createDataFrame(rows, "id long, concept string, ids array<long>")
    got = {r.id: r.t for r in cg.loose_ids(df, "ids", "t").collect()}
    assert got == {1: "c:5", 2: "c:5", 3: "c:5", 4: "c:4", 5: "c:#5", 6: "d:5", 7: "d:1"}


def test_morphemes_are_clustered_without_a_table_of_their_pairs(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, "c", f"{rng.choice(['t a', 't i', 'k o'])} + {rng.choice(['n u', 'n o'])}") for k in range(120)]
    df = spark.createDataFrame(rows, "id long, concept string, form string").withColumn("segments", F.split("form", " "))
    kept = watched(monkeypatch, cg, lk)
    got = cg.partial_clusters(df, st.ldn, 0.4).collect()
    assert max(kept) <= 240 and len(got) == 120 and all(len(set(r.partialids)) == 2 for r in got)


def test_morphemes_of_a_word_stay_apart(spark):
    rows = [(1, "A", "c", "t a + t a"), (2, "B", "c", "t a"), (3, "C", "c", "t i + k o"), (4, "D", "c", "k o"), (5, "E", "d", "k o"), (6, "F", "c", None)]
    df = spark.createDataFrame(rows, "id long, doculect string, concept string, form string").withColumn("segments", F.split("form", " "))
    got = {r.id: r.partialids for r in cg.partial_clusters(df, st.ldn, 0.4).collect()}
    assert got[6] is None and got[5] == ["d:5/0"] and got[3][1] == got[4][0] == "c:3/1" and got[3][0] == "c:3/0"
    assert got[1][0] != got[1][1] and got[2][0] in got[1]
    assert cg.partial_clusters(df.limit(0), st.ldn, 0.4).count() == 0

"""Multiple alignments by rounds over all sets, against the kernels in the same order of merges."""

import hashlib
import random

import pytest

from glossarium.functions import align as al
from glossarium.operators import alignments as am
from glossarium.operators import multiple as mu


def blocks(seed, letters="abcd", longest=7, count=4):
    rng = random.Random(seed)
    found = {str(k): {" ".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(rng.randint(1, 8))} for k in range(count)}
    found["alone"], found["empty"] = {"x y z"}, {"", "a b"}
    return found


def guided(items, weights=None):
    """Rows by merging the nearest two clusters (ties by md5 of their least items), with the kernel of two alignments."""
    items = sorted(items)
    split = {i: i.split(" ") for i in items}
    d = {(a, b): al.align_pair(split[a], split[b])[3] for a in items for b in items if a < b}
    groups = {i: [i] for i in items}
    coded = {i: [f"{i}.{k}" if weights is not None else x for k, x in enumerate(split[i])] for i in items}
    rows = {i: [coded[i]] for i in items}
    scorer, gop, scale, gap_weight = al.match_scorer(), -1.0, 0.5, 0.5
    if weights is not None:
        scorer, gop, scale, gap_weight = (lambda x, y: weights.get((x, y), weights.get((y, x), 0.0))), 0.0, 1.0, 0.0
    while len(groups) > 1:
        mean = lambda x, y: sum(d[min(i, j), max(i, j)] for i in groups[x] for j in groups[y]) / len(groups[x]) / len(groups[y])
        _, _, a, b = min((round(mean(x, y), 9), hashlib.md5(f"{x}|{y}".encode()).hexdigest(), x, y) for x in groups for y in groups if x < y)
        rows[a] = al.merge(rows[a], rows.pop(b), scorer, gop, scale, gap_weight)[0]
        groups[a] += groups.pop(b)
    (root,) = groups
    place = lambda i, x: x if x == "-" or weights is None else split[i][int(x.rpartition(".")[2])]
    return {i: [place(i, x) for x in row] for i, row in zip(groups[root], rows[root])}


def frame(spark, found):
    return spark.createDataFrame([(b, i) for b, items in found.items() for i in items], "block string, item string").repartition(3)


def test_progressive_is_that_of_the_guide_tree(spark):
    found = blocks(3)
    rows = mu.align_items(frame(spark, found)).collect()
    assert len(rows) == sum(map(len, found.values()))
    of = {b: {r.item: r.alignment for r in rows if r.block == b} for b in found}
    for b, items in found.items():
        filled = items - {""}
        assert {i: x for i, x in of[b].items() if i} == guided(filled)
        assert len({len(x) for x in of[b].values()}) == 1
    assert of["empty"][""] == ["-", "-"]


def test_library_weights_and_alignment(spark):
    found = blocks(8, "abc", 5, 3)
    units = frame(spark, found)
    got = {}
    for r in mu.library_weights(units).collect():
        assert r.a < r.b
        got.setdefault(r.block, {})[f"{r.a}.{r.i}", f"{r.b}.{r.j}"] = r.weight
    aligned = mu.align_items(units, "library").collect()
    for b, items in found.items():
        names = sorted(items - {""})
        split = [n.split(" ") for n in names]
        plain = al.library_scorer(split, al.match_scorer(), -1.0, 0.5)
        want = {(f"{names[s]}.{i}", f"{names[t]}.{j}"): w for ((s, i), (t, j)), w in plain.items() if s < t}
        assert got.get(b, {}).keys() == want.keys()
        assert all(got[b][k] == pytest.approx(w) for k, w in want.items())
        assert {r.item: r.alignment for r in aligned if r.block == b and r.item} == guided(names, got.get(b, {}))


def test_sum_of_pairs_is_not_worse_than_one_group_gives(spark):
    """Trees can differ where distances are equal."""
    found = blocks(21, count=12)
    rows = mu.align_items(frame(spark, found)).collect()
    new = old = 0.0
    for b, items in found.items():
        new += al.sum_of_pairs([r.alignment for r in rows if r.block == b and r.item], al.match_scorer(), 0.5)
        old += al.sum_of_pairs(al.progressive([i.split(" ") for i in sorted(items) if i]), al.match_scorer(), 0.5)
    assert new >= old - 1e-9


def test_words_without_form_or_set_and_clashing_names(spark):
    rows = [(1, "abc", "s", "p"), (2, "ac", "s", "q"), (3, "ac", "s", None), (4, None, "s", "r"), (5, "abc", None, "r"), (6, "", "s", "r"), (7, "", "t", "r")]
    words = spark.createDataFrame(rows, "id long, form string, cogid string, block string").selectExpr("*", "form AS item", "1 AS _rank")
    got = {r.id: r.alignment for r in am.align_sets(words).collect()}
    assert got == {1: ["a", "b", "c"], 2: ["a", "-", "c"], 3: ["a", "-", "c"], 4: None, 5: None, 6: ["-", "-", "-"], 7: []}
    assert am.align_sets(words).columns == [*words.columns, "alignment"]
    assert am.align_sets(words.limit(0)).count() == 0
    with pytest.raises(ValueError):
        am.align_sets(words, method="other")

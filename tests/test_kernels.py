"""Kernels against values that are known or worked out by brute force."""

import itertools
import random

import numpy as np
import pytest

from glossarium.functions import align as al
from glossarium.functions import clusters as cl
from glossarium.functions import sounds as so
from glossarium.functions import trees as tr

MATRIX = np.array([[0.0, 0.5, 0.67, 0.8, 0.2], [0.5, 0.0, 0.4, 0.7, 0.6], [0.67, 0.4, 0.0, 0.8, 0.8], [0.8, 0.7, 0.8, 0.0, 0.3], [0.2, 0.6, 0.8, 0.3, 0.0]])
TAXA = ["German", "Swedish", "Icelandic", "English", "Dutch"]


def best_global(a, b, gap=-1.0):
    """Needleman-Wunsch by recursion over all ends."""
    if not a or not b:
        return gap * (len(a) + len(b))
    match = 1 if a[-1] == b[-1] else -1
    return max(best_global(a[:-1], b[:-1], gap) + match, best_global(a[:-1], b, gap) + gap, best_global(a, b[:-1], gap) + gap)


def test_global_score():
    rng = random.Random(0)
    for _ in range(30):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(2))
        assert al.align_pair(a, b, scale=1.0)[2] == best_global(a, b)
    assert al.align_pair("waldemar", "vladimir", scale=1.0)[2] == -1


def test_rows_without_gaps_are_the_input():
    for mode in ("global", "overlap", "dialign"):
        x, y, _, _ = al.align_pair("waldemar", "vladimir", mode=mode)
        assert "".join(x).replace("-", "") == "waldemar" and "".join(y).replace("-", "") == "vladimir" and len(x) == len(y)


def test_local():
    assert al.align_pair("waldemar", "wald", mode="local", scale=1.0)[2] == 4
    assert al.align_pair("waldemar", "vladimir", mode="local")[2] == 1
    found = al.local_alignments("waldemar", "marwalde")
    assert [s for *_, s in found][:2] == [5, 3]


def test_distance_is_zero_for_equal_and_symmetric():
    assert al.align_pair("wald", "wald")[3] == 0
    assert al.align_pair("wald", "welt")[3] == al.align_pair("welt", "wald")[3]


def test_restricted():
    kinds = {c: "v" if c in "aei" else "c" for c in "waldemrvi"}
    kind = lambda w: "".join(kinds[c] for c in w)
    assert al.restricted_edit_distance("waldemar", "vladimir", kind("waldemar"), kind("vladimir")) == 5


def test_multiple():
    seqs = [list(w) for w in ("waldemar", "woldemort", "vladimir", "waldemar")]
    for rows in (al.progressive(seqs), al.progressive(seqs, refine=True), al.library_align(seqs)):
        assert len({len(r) for r in rows}) == 1
        assert [[x for x in r if x != "-"] for r in rows] == seqs
        assert rows[0] == rows[3]
    assert "".join(al.progressive(seqs[:3])[0]) == "wal-demar-"


def test_consensus():
    assert al.consensus([list("wa-d"), list("wald"), list("wo-d")]) == list("wad")
    assert al.consensus([list("wa-d"), list("wald"), list("wo-d")], gaps=True) == list("wa-d")


def brute_flat(d, threshold, link):
    clusters = [[i] for i in range(len(d))]
    while len(clusters) > 1:
        pairs = [(link([d[i][j] for i in a for j in b]), x, y) for (x, a), (y, b) in itertools.combinations(enumerate(clusters), 2)]
        best = min(pairs)
        if best[0] > threshold:
            break
        clusters[best[1]] += clusters.pop(best[2])
    return sorted(sorted(c) for c in clusters)


@pytest.mark.parametrize("method,link", [("upgma", lambda x: sum(x) / len(x)), ("single", min), ("complete", max)])
def test_flat_clusters(method, link):
    rng = np.random.default_rng(1)
    for _ in range(10):
        d = rng.random((8, 8))
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        labels = cl.flat_cluster(d, 0.4, method)
        assert sorted(sorted(i for i, x in enumerate(labels) if x == k) for k in set(labels)) == brute_flat(d, 0.4, link)


def test_trees_of_distances():
    for text in (cl.upgma_newick(MATRIX, TAXA), cl.neighbor_newick(MATRIX, TAXA)):
        assert sorted(tr.parse(text).tips()) == sorted(TAXA)
    assert "(German:0.10,Dutch:0.10)" in cl.upgma_newick(MATRIX, TAXA)
    with pytest.raises(ValueError):
        cl.upgma_newick(MATRIX[:2, :2], ["Eng:lish", "x"])


def test_other_clusterings():
    two = np.array([[0, 0.1, 0.9, 0.9], [0.1, 0, 0.9, 0.9], [0.9, 0.9, 0, 0.1], [0.9, 0.9, 0.1, 0]])
    for labels in (cl.flat_cluster(two, 0.5, "ward"), cl.flat_cluster(two, 0.5, "infomap"), cl.affinity_propagation(1 - two)):
        assert labels == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        cl.flat_cluster(two, 0.5, "none")
    assert cl.fuzzy_clusters(two, 0.5) == [[1], [1], [2], [2]]
    assert [len(x) for x in cl.link_communities(two, 0.5)] == [1, 1, 1, 1]


def test_tokens():
    assert so.tokens("tʰoxtər") == ["tʰ", "o", "x", "t", "ə", "r"]
    assert so.tokens("t͡sai") == ["t͡s", "ai"]
    assert so.tokens("t͡sai", merge_vowels=False) == ["t͡s", "a", "i"]
    assert len(so.tokens("ʰto͡i")) == 2
    with pytest.raises(ValueError):
        so.tokens("th o x t a")


def test_classes_and_prosody():
    assert so.classes(["tʰ", "ɔ", "x", "ˈt"]) == ["T", "V", "K", "T"]
    with pytest.raises(ValueError):
        so.classes(["?", "!"])
    assert so.prosody(list("tata"), "cv") == "CVCV"
    assert so.prosody(list("tam"))[0] == "A" and so.prosody(list("tam"))[-1] == "N"
    assert so.first_consonants(list("waldemar")) == "WR" and so.first_consonants(list("vladimir")) == "PR"
    assert so.turchin(list("waldemar"), list("vladimir")) == 1 and so.turchin(list("tak"), list("dax")) == 0
    assert so.turchin(list("tak"), list("dog")) == 0
    assert so.syllables(list("tata")) == [["t", "a"], ["t", "a"]]
    assert so.morphemes(["a", "+", "b", "c"]) == [["a"], ["b", "c"]]
    assert so.clean("abd/ak (x)") == ["a b d", "a k"]


def test_gap_weights_and_grams():
    assert so.gap_weights("AXBYN") == [2.0, 1.5, 1.75, 1.3, 0.8]
    assert so.gap_weights("AXT") == [1.6, 3.0, 1.0]
    assert [t for t, _ in so.prosodic_grams(list("tam"))] == list("tam") and "".join(p for _, p in so.prosodic_grams(list("tam"))) == so.prosody(list("tam"))


def test_asjp():
    assert so.asjp_tokens("haus") == ["h", "au", "s"] and so.asjp_tokens("haus", merge_vowels=False) == list("haus")
    assert so.asjp_tokens("tw~a") == ["tw~", "a"] and so.asjp_tokens("ndy$o") == ["ndy$", "o"] and so.asjp_tokens('t"a*') == ['t"', "a*"]
    assert so.asjp_tokens("") == []
    with pytest.raises(ValueError):
        so.asjp_tokens("a b")


def test_model():
    assert so.read_model("A : x, y\nB : z")["z"] == "B"
    with pytest.raises(ValueError):
        so.read_model("A : x\nB : x")


def test_newick_and_distances():
    a, b = tr.parse("(((A,B),C),(D,E));"), tr.parse("(((A,C),B),(D,E));")
    assert tr.to_newick(a) == "(((A,B),C),(D,E));"
    assert tr.tree_distance(a, a) == 0 and tr.tree_distance(a, b, "symmetric") == 2
    assert tr.depth(a, "A") == 3
    assert sorted(tr.random_tree(list("ABCD"), 1).tips()) == list("ABCD")
    assert len(tr.hull([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)])) == 4


def test_gain_loss_is_the_cheapest():
    tree = tr.parse("(((A,B),C),(D,E));")
    names = [n.name for n in tree.walk()]
    parent = {n: p for n, p, _ in tr.edges(tree)}
    for pattern in itertools.product((0, 1), repeat=5):
        states = dict(zip("ABCDE", pattern))
        scenario, gains = tr.gain_loss(states, tree)
        reached = tr.node_states(scenario, tree)
        assert all(reached[t] == s for t, s in states.items())
        inner = [n for n in names if n not in states]
        best = min(
            (x := dict(zip(inner, values)) | states)["root"] + sum(x[n] != x[p] for n, p in parent.items()) for values in itertools.product((0, 1), repeat=len(inner))
        )
        assert len(scenario) == best and gains == sum(s for _, s in scenario)


def test_structural():
    found = al.structural_alignments("abab", "bab")
    assert found == [(list("abab"), list("-bab"))]
    for x, y in al.structural_alignments("waldemar", "vladimir"):
        assert "".join(x).replace("-", "") == "waldemar" and "".join(y).replace("-", "") == "vladimir"
    with pytest.raises(ValueError):
        al.structural_alignments("a" * 20, "b")


def test_generation():
    from glossarium.functions import generate as ge

    walker = ge.Walker([("#", "a", 2), ("a", "b", 1), ("a", "$", 1), ("b", "$", 1)])
    assert {"".join(walker.walk(random.Random(k))) for k in range(30)} == {"a", "ab"}
    assert abs(walker.score(["a", "b"]) - np.log10(0.5)) < 1e-12 and walker.score(["b"]) == float("-inf")
    assert [len(list(ge.label_sets(n))) for n in (1, 2, 3, 4)] == [1, 2, 5, 15]
    assert ge.random_labels(5, random.Random(1))[0] == 1

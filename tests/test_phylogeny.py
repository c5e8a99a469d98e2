"""Scenarios on trees against the kernel for one pattern, and spanning trees against Kruskal's algorithm."""

import random
from itertools import combinations

import pytest

from glossarium.functions import trees as tr
from glossarium.operators import phylogeny as ph


@pytest.mark.parametrize("gain, loss", [(1.0, 1.0), (2.0, 1.0), (1.0, 3.0)])
def test_scenarios_are_those_of_single_patterns(spark, gain, loss):
    rng = random.Random(4)
    taxa = [f"t {k}" for k in range(9)]
    tree = tr.random_tree([t.replace(" ", "_") for t in taxa], 3)
    newick = tr.to_newick(tree)
    rows = [(f"s{k}", t, rng.choice([0, 0, 1, 1, -1])) for k in range(60) for t in taxa if rng.random() < 0.95]
    rows.append(("s0", None, 1))
    got = ph.scenarios(spark.createDataFrame(rows, "cogid string, doculect string, state int"), newick, gain=gain, loss=loss).collect()
    parsed = tr.parse(newick)
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        states = {t.replace(" ", "_"): s if s >= 0 else None for k, t, s in rows if k == r.cogid and t}
        changes, origins = tr.gain_loss(states, parsed, gain, loss)
        assert (r.scenario, r.origins) == (",".join(f"{n}:{s}" for n, s in changes), origins)
        assert sorted(r.present) == sorted(n for n, s in tr.node_states(changes, parsed).items() if s)


def test_sizes(spark):
    tree = [("A", "r"), ("B", "r"), ("r", "root"), ("C", "root")]
    rows = [("x", "A", 1), ("x", "B", 1), ("x", "C", 0), ("y", "A", 1), ("y", "B", 0), ("y", "C", 1)]
    found = ph.scenarios(spark.createDataFrame(rows, "cogid string, doculect string, state int"), tree)
    assert {r.cogid: r.scenario for r in found.collect()} == {"x": "r:1", "y": "A:1,C:1"}
    assert {r.node: r.sets for r in ph.vocabulary_sizes(found).collect()} == {"A": 2, "B": 1, "C": 1, "r": 1}
    assert {r.node: r.sets for r in ph.inherited_sizes(found, tree).collect()} == {"A": 1, "B": 1}
    assert [tuple(r) for r in ph.lateral_edges(found, tree).collect()] == [("A", "C", 1)]
    for bad in ([("A", "r"), ("B", "q")], [("A", "r"), ("A", "r")], [("A", "B"), ("B", "A"), ("C", "r")]):
        with pytest.raises(ValueError):
            ph.scenarios(spark.createDataFrame(rows, "cogid string, doculect string, state int"), bad)


def test_spanning_trees(spark):
    rng = random.Random(8)
    rows, want = [], set()
    for block in ("p", "q", "r"):
        nodes = [f"n{k}" for k in range(rng.randint(2, 12))]
        weights = {e: float(rng.choice([1, 2, 3, 4])) for e in combinations(sorted(nodes), 2)}
        rows += [(block, a, b, -w) for (a, b), w in weights.items()]
        want |= {(block, a, b) for a, b in ph.spanning_tree(nodes, weights)}
    edges = spark.createDataFrame(rows, "block string, a string, b string, cost double")
    assert {tuple(r) for r in ph.spanning_trees(edges).collect()} == want
    assert ph.spanning_trees(edges.limit(0)).count() == 0

"""Trees of doculects: Newick, distances between trees, and gain-loss scenarios by weighted parsimony."""

from __future__ import annotations

import random
from dataclasses import dataclass, field


@dataclass
class Node:
    name: str
    length: float = 0.0
    children: list["Node"] = field(default_factory=list)

    def walk(self):
        """Children before parents."""
        for c in self.children:
            yield from c.walk()
        yield self

    def tips(self) -> list[str]:
        return [n.name for n in self.walk() if not n.children]


def parse(newick: str) -> Node:
    """A tree from Newick; inner nodes without names are root, edge.0, edge.1 and so on, in the order of the text."""
    at, unnamed = 0, iter(range(1 << 30))

    def node() -> Node:
        nonlocal at
        children = []
        if newick[at] == "(":
            while newick[at] in "(,":
                at += 1
                children.append(node())
            at += 1
        start = at
        while at < len(newick) and newick[at] not in "(),:;":
            at += 1
        name, length = newick[start:at].strip(), 0.0
        if at < len(newick) and newick[at] == ":":
            start = at = at + 1
            while at < len(newick) and newick[at] not in "(),;":
                at += 1
            length = float(newick[start:at])
        return Node(name or f"edge.{next(unnamed)}", length, children)

    newick = newick.strip()
    root = node()
    if root.name.startswith("edge."):
        root.name = "root"
    return root


def to_newick(tree: Node, lengths: bool = False) -> str:
    def text(n: Node) -> str:
        inner = f"({','.join(map(text, n.children))})" if n.children else ""
        return f"{inner}{'' if n.name.startswith(('edge.', 'root')) else n.name}" + (f":{n.length:g}" if lengths else "")

    return text(tree) + ";"


def edges(tree: Node) -> list[tuple[str, str, float]]:
    """(node, parent, length) for every node but the root: rows for a DataFrame of the tree."""
    return [(c.name, n.name, c.length) for n in tree.walk() for c in n.children]


def bipartitions(tree: Node) -> set[frozenset[str]]:
    """The sides (without the first taxon) of all splits that are not trivial."""
    tips = sorted(tree.tips())
    out = set()
    for n in tree.walk():
        side = frozenset(n.tips())
        side = frozenset(tips) - side if tips[0] in side else side
        if 1 < len(side) < len(tips) - 1:
            out.add(side)
    return out


def tree_distance(a: Node, b: Node, kind: str = "rf") -> float:
    """rf: share of splits that are in one tree only; symmetric: their number; grf: share of a's splits that conflict with one of b."""
    x, y = bipartitions(a), bipartitions(b)
    if kind == "symmetric":
        return float(len(x ^ y))
    if kind == "grf":
        fits = lambda s, t: not (s & t) or s <= t or t <= s
        return sum(not all(fits(s, t) for t in y) for s in x) / len(x) if x else 0.0
    return len(x ^ y) / (len(x) + len(y)) if x or y else 0.0


def random_tree(taxa: list[str], seed: int) -> Node:
    rng, nodes = random.Random(seed), [Node(t) for t in taxa]
    for k in range(len(taxa) - 1):
        a, b = nodes.pop(rng.randrange(len(nodes))), nodes.pop(rng.randrange(len(nodes)))
        nodes.append(Node("root" if len(nodes) == 0 else f"edge.{k}", 0.0, [a, b]))
    return nodes[0]


def depth(tree: Node, name: str) -> int:
    """Edges from the root to a node."""
    todo = [(tree, 0)]
    while todo:
        n, k = todo.pop()
        if n.name == name:
            return k
        todo += [(c, k + 1) for c in n.children]
    raise KeyError(name)


def gain_loss(states: dict[str, int | None], tree: Node, gain: float = 1.0, loss: float = 1.0) -> tuple[list[tuple[str, int]], int]:
    """A cheapest scenario, [(node, 1 for a gain or 0 for a loss)], and its number of gains.

    states: 1 or 0 of each tip, null if missing (any state). Costs by node and
    state are worked out from the tips up (Sankoff), so nothing is enumerated;
    of equally cheap scenarios the one with later gains is taken.
    """
    cost: dict[int, tuple[float, float]] = {}
    change = {(0, 1): gain, (1, 0): loss, (0, 0): 0.0, (1, 1): 0.0}
    for n in tree.walk():
        if not n.children:
            s = states.get(n.name)
            cost[id(n)] = (0.0 if s in (0, None) else float("inf"), 0.0 if s in (1, None) else float("inf"))
        else:
            cost[id(n)] = tuple(sum(min(change[x, y] + cost[id(c)][y] for y in (0, 1)) for c in n.children) for x in (0, 1))
    absent, present = cost[id(tree)]
    state = 0 if absent <= gain + present else 1
    out, gains = ([(tree.name, 1)], 1) if state else ([], 0)
    todo = [(tree, state)]
    while todo:
        n, x = todo.pop()
        for c in n.children:
            y = min((0, 1), key=lambda y: (change[x, y] + cost[id(c)][y], y))
            if y != x:
                out.append((c.name, y))
                gains += y
            todo.append((c, y))
    return sorted(out), gains


def node_states(scenario: list[tuple[str, int]], tree: Node) -> dict[str, int]:
    """The state of every node under a scenario."""
    changes, out = dict(scenario), {}
    todo = [(tree, 0)]
    while todo:
        n, x = todo.pop()
        out[n.name] = changes.get(n.name, x)
        todo += [(c, out[n.name]) for c in n.children]
    return out


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise from the least point."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(ps):
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])

"""Clustering kernels over distance matrices of one concept's words or of the doculects, both small."""

from __future__ import annotations

from hashlib import md5
from itertools import combinations

import numpy as np


def agglomerate(d: np.ndarray, linkage: str = "average", threshold: float = np.inf) -> list[tuple[int, int, int, float]]:
    """Merges (a, b, new, distance) of the nearest clusters until none is within threshold; leaves are 0 to n - 1, ties go to the first pair.

    Distances to a merged cluster follow from those to its parts (Lance and
    Williams), so a merge costs one row of the matrix.
    """
    n = len(d)
    d = np.asarray(d, float).copy()
    if linkage == "ward":
        d = d**2
    np.fill_diagonal(d, np.inf)
    ids, sizes, out = list(range(n)), np.ones(n), []
    live = np.ones(n, bool)
    for step in range(n - 1):
        view = np.where(live[:, None] & live[None, :], d, np.inf)
        i, j = np.unravel_index(int(view.argmin()), view.shape)
        if not view[i, j] <= threshold:
            break
        i, j = min(i, j), max(i, j)
        out.append((ids[i], ids[j], n + step, float(d[i, j])))
        if linkage == "single":
            row = np.minimum(d[i], d[j])
        elif linkage == "complete":
            row = np.maximum(d[i], d[j])
        else:
            row = (d[i] * sizes[i] + d[j] * sizes[j]) / (sizes[i] + sizes[j])
        row[i] = np.inf
        d[i], d[:, i] = row, row
        sizes[i] += sizes[j]
        live[j] = False
        ids[i] = n + step
    return out


def merged_in_rounds(total: np.ndarray, names: list[str], threshold: float, linkage: str = "average", decimals: int = 9) -> np.ndarray:
    """The least item of each item's cluster by average or complete linkage; total is a symmetric matrix, which is changed.

    All pairs of clusters that are each other's nearest merge in a round; equal
    distances (to decimals) go by the md5 of the least items' names, "a|b".
    Items at an infinite distance never meet.
    """
    root, live, size = np.arange(len(total)), np.arange(len(total)), np.ones(len(total))
    np.fill_diagonal(total, np.inf)
    while len(live) > 1:
        mean = total
        if linkage == "average":
            mean = np.multiply.outer(size, size)
            np.divide(total, mean, out=mean)
        least = mean.min(axis=1)
        nearest = np.round(least, decimals)
        found = np.nonzero(mean <= np.where(nearest <= threshold, least + 2 * 10.0**-decimals, -np.inf)[:, None])
        i, j = np.divmod(np.unique(np.minimum(*found) * len(live) + np.maximum(*found)), len(live))
        value = np.round(mean[i, j], decimals)
        own = value[:, None] == np.stack([nearest[i], nearest[j]], axis=1)
        digests = np.frombuffer(b"".join(md5(f"{names[a]}|{names[b]}".encode()).digest() for a, b in zip(live[i], live[j])), ">u8").reshape(-1, 2)
        rank, first = np.empty(len(i), np.int64), np.full(len(live), len(i))
        rank[np.lexsort((digests[:, 1], digests[:, 0]))] = np.arange(len(i))
        for k, side in enumerate((i, j)):
            np.minimum.at(first, side[own[:, k]], rank[own[:, k]])
        both = own.all(axis=1) & (first[i] == rank) & (first[j] == rank)
        if not both.any():
            break
        i, j = i[both], j[both]
        join = np.add if linkage == "average" else np.maximum
        total[i] = join(total[i], total[j])
        total[:, i] = join(total[:, i], total[:, j])
        if linkage == "average":  # sums in another order
            total[np.ix_(i, i)] = (total[np.ix_(i, i)] + total[np.ix_(i, i)].T) / 2
        size[i] += size[j]
        to = np.arange(len(root))
        to[live[j]] = live[i]
        root = to[root]
        rest = np.ones(len(live), bool)
        rest[j] = False
        live, size, total = live[rest], size[rest], total[np.ix_(rest, rest)]
    return root


def average_linkage(d: np.ndarray) -> list[tuple[int, int, int, float]]:
    return agglomerate(d, "average")


def labels_of(n: int, merges: list[tuple[int, int, int, float]]) -> list[int]:
    """Cluster numbers from 1, by first place."""
    parent = {m: m for m in range(n + len(merges))}
    for a, b, new, _ in merges:
        parent[a] = parent[b] = new
    def root(x: int) -> int:
        while x in parent and parent[x] != x:
            x = parent[x]
        return x
    return order_labels([root(i) for i in range(n)])


def order_labels(labels: list) -> list[int]:
    """The same clusters numbered from 1 by first place."""
    seen: dict = {}
    return [seen.setdefault(x, len(seen) + 1) for x in labels]


def flat_cluster(d: np.ndarray, threshold: float, method: str = "upgma") -> list[int]:
    """Cluster numbers by upgma, single, complete or ward linkage cut at threshold, or infomap."""
    kinds = {"upgma": "average", "single": "single", "complete": "complete", "ward": "ward"}
    if method == "infomap":
        return infomap_clusters(d, threshold)
    if method not in kinds:
        raise ValueError(f"unknown method: {method}")
    return labels_of(len(d), agglomerate(d, kinds[method], threshold))


def link_communities(d: np.ndarray, threshold: float) -> list[list[int]]:
    """Communities of edges (Ahn et al., 2010): each node's communities, numbered by the least edge; edges join by the overlap of their open ends' neighbours."""
    n = len(d)
    near = {i: {i, *(j for j in range(n) if j != i and d[i][j] <= threshold)} for i in range(n)}
    edges = [(i, j) for i in range(n) for j in sorted(near[i]) if i < j]
    links = []
    for x, y in combinations(range(len(edges)), 2):
        shared = set(edges[x]) & set(edges[y])
        if len(shared) == 1:
            a, b = (set(edges[x]) - shared).pop(), (set(edges[y]) - shared).pop()
            links.append((len(near[a] & near[b]) / len(near[a] | near[b]), x, y))
    best, cut = -1.0, 1.0
    for level in sorted({s for s, _, _ in links}, reverse=True):
        groups = _joined(len(edges), [(x, y) for s, x, y in links if s >= level])
        density = 0.0
        for g in groups:
            nodes = {v for e in g for v in edges[e]}
            if len(nodes) > 2:
                density += len(g) * (len(g) - len(nodes) + 1) / ((len(nodes) - 2) * (len(nodes) - 1))
        density *= 2 / max(1, len(edges))
        if density > best:
            best, cut = density, level
    groups = _joined(len(edges), [(x, y) for s, x, y in links if s >= cut])
    member: list[list[int]] = [[] for _ in range(n)]
    for k, g in enumerate(sorted(groups, key=min), 1):
        for v in sorted({v for e in g for v in edges[e]}):
            member[v].append(k)
    k = len(groups)
    for own in member:
        if not own:
            k += 1
            own.append(k)
    return member


def _joined(n: int, pairs: list[tuple[int, int]]) -> list[list[int]]:
    parent = list(range(n))
    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for x, y in pairs:
        parent[max(find(x), find(y))] = min(find(x), find(y))
    out: dict[int, list[int]] = {}
    for x in range(n):
        out.setdefault(find(x), []).append(x)
    return list(out.values())


def affinity_propagation(similarity: np.ndarray, damping: float = 0.5, steps: int = 200) -> list[int]:
    """Exemplar clusters (Frey and Dueck, 2007), the median similarity as preference."""
    s = np.asarray(similarity, float).copy()
    n = len(s)
    if n < 2:
        return [1] * n
    np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]))
    s = s + 1e-12 * np.arange(n * n).reshape(n, n)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    rows = np.arange(n)
    for _ in range(steps):
        both = a + s
        first = both.argmax(axis=1)
        top = both[rows, first]
        both[rows, first] = -np.inf
        new = s - top[:, None]
        new[rows, first] = s[rows, first] - both.max(axis=1)
        r = damping * r + (1 - damping) * new
        positive = np.maximum(r, 0)
        positive[rows, rows] = r[rows, rows]
        new = positive.sum(axis=0)[None, :] - positive
        own = new[rows, rows].copy()
        new = np.minimum(new, 0)
        new[rows, rows] = own
        a = damping * a + (1 - damping) * new
    return order_labels((a + r).argmax(axis=1).tolist())


def upgma_newick(d: np.ndarray, taxa: list[str], distances: bool = True) -> str:
    """Tree by average linkage, branch lengths with two decimals."""
    check_taxa(taxa)
    names: dict[int, tuple[str, float]] = {i: (t, 0.0) for i, t in enumerate(taxa)}
    for a, b, new, height in average_linkage(np.asarray(d, float)):
        (x, hx), (y, hy) = names.pop(a), names.pop(b)
        mark = lambda h: f":{height / 2 - h:.2f}" if distances else ""
        names[new] = f"({x}{mark(hx)},{y}{mark(hy)})", height / 2
    return next(iter(names.values()))[0] + ";"


def neighbor_newick(d: np.ndarray, taxa: list[str], distances: bool = True) -> str:
    """Tree by neighbour joining (Saitou and Nei, 1987)."""
    check_taxa(taxa)
    d, names = np.asarray(d, float).copy(), list(taxa)
    length = lambda x: f":{x:.2f}" if distances else ""
    while len(names) > 2:
        n, total = len(names), d.sum(axis=1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(np.unravel_index(int(q.argmin()), q.shape))
        li = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        name = f"({names[i]}{length(li)},{names[j]}{length(d[i, j] - li)})"
        row = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], row[keep][:, None]], [row[keep][None, :], np.zeros((1, 1))]])
        names = [names[k] for k in keep] + [name]
    return f"({names[0]}{length(d[0, 1])},{names[1]}{length(0)});" if len(names) == 2 else f"{names[0]};"


def check_taxa(taxa: list[str]) -> None:
    if bad := [t for t in taxa if set(t) & set("():;,")]:
        raise ValueError(f"taxon names with marks of trees: {bad}")


def fuzzy_clusters(d: np.ndarray, threshold: float, method: str = "upgma") -> list[list[int]]:
    """Overlapping clusters: largest cliques of the pairs that stay together in every clustering without one other element; each element's cliques."""
    n = len(d)
    together = np.zeros((n, n), int)
    for out in range(n):
        keep = [i for i in range(n) if i != out]
        labels = flat_cluster(np.asarray(d)[np.ix_(keep, keep)], threshold, method)
        for (i, a), (j, b) in combinations(zip(keep, labels), 2):
            together[i, j] += a == b
    near = {i: {j for j in range(n) if j != i and together[min(i, j), max(i, j)] > 0} for i in range(n)}
    cliques: list[list[int]] = []
    todo: list[tuple[list[int], set[int], set[int]]] = [([], set(range(n)), set())]
    while todo:
        clique, free, done = todo.pop()
        if not free and not done:
            cliques.append(sorted(clique))
            continue
        pivot = max(free | done, key=lambda x: (len(near[x] & free), x))
        for x in sorted(free - near[pivot]):
            todo.append(([*clique, x], free & near[x], done & near[x]))
            free, done = free - {x}, done | {x}
    return [[k for k, c in enumerate(sorted(cliques), 1) if i in c] for i in range(n)]


def find_threshold(d: np.ndarray, steps: int = 18) -> float:
    """The threshold (of twentieths) after which the weighted mean degree of the graph of near pairs grows least."""
    d = np.asarray(d, float)
    off = ~np.eye(len(d), dtype=bool)
    degrees = [float(((1 - d) * (d <= t) * off).sum() / max(1, len(d))) for t in np.arange(1, steps + 1) / 20]
    gains = np.diff(degrees)
    return float((int(gains.argmin()) + 1) / 20) if len(gains) else 0.5


def map_equation(weights: np.ndarray, labels: np.ndarray) -> float:
    """Bits a step of a random walk on an undirected graph takes with a code book for each cluster (Rosvall and Bergstrom, 2008)."""
    total = weights.sum()
    if total == 0:
        return 0.0
    flow = weights.sum(axis=1) / total
    log = lambda p: np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0.0)
    names = np.unique(labels)
    inside = np.array([flow[labels == k].sum() for k in names])
    leave = np.array([weights[np.ix_(labels == k, labels != k)].sum() / total for k in names])
    return float(log(np.array([leave.sum()]))[0] - 2 * log(leave).sum() - log(flow).sum() + log(leave + inside).sum())


def infomap_clusters(d: np.ndarray, threshold: float) -> list[int]:
    """Clusters of the graph of distances within threshold that make the map equation small: nodes, then whole clusters, move while it falls."""
    d = np.asarray(d, float)
    w = np.where(d <= threshold, 1 - d + 1e-9, 0.0)
    np.fill_diagonal(w, 0.0)
    labels = np.arange(len(d))
    best = map_equation(w, labels)
    improved = True
    while improved:
        improved = False
        units = [[i] for i in range(len(d))] + [np.flatnonzero(labels == k).tolist() for k in np.unique(labels)]
        for unit in units:
            targets = np.unique(labels[np.flatnonzero(w[unit].sum(axis=0) > 0)])
            for target in targets:
                if target == labels[unit[0]]:
                    continue
                trial = labels.copy()
                trial[unit] = target
                value = map_equation(w, trial)
                if value < best - 1e-12:
                    best, labels, improved = value, trial, True
    return order_labels(labels.tolist())

"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits; two are linked if at most radius bits differ. The bits
are dealt into partitions, correlated bits together, and the partitions get
thresholds t_i of their own (-1: not used) with sum(t_i + 1) = radius + 1: a
linked pair is within t_i in some partition i. Dynamic programming picks the
thresholds of the least estimated cost, rows to probe and candidates to verify,
from a bounded sample of fingerprints; the choice changes cost, never what is
linked within radius.

With further words of 64 bits a candidate is verified on all words, against a
limit of its own (near), which must not be beyond radius: what lies further is
only met by chance, and by other chances for other partitions and sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingle_sets
from .bpe import blocks
from .common import materialise
from .components import components

BITS = 64
#: Rows of a bucket that one task compares with each other; larger buckets are split.
BUCKET_ROWS = 4096


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits of each hash, by the finaliser of splitmix64; word 0 is the hash itself."""
    if not word:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(word) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's word shingles, with repeats; of a text with fewer words than a shingle, of the whole."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def fingerprint(text: str, shingle: int, words: int = 1) -> list[int]:
    """SimHash of the text's word shingles, as signed 64-bit words; 0 without words.

    Words: runs of other than ASCII white space, A-Z lower-cased. A text with
    fewer words than a shingle is one shingle. Repeats count. A bit is set if
    it is in over half of the shingles' XXH64 (seed 42).
    """
    return combined(shingles(text, shingle), words)


def combined(values: np.ndarray, words: int = 1) -> list[int]:
    """fingerprint() of the hashes of a text's shingles."""
    if not len(values):
        return [0] * words
    out = []
    for word in range(words):
        counts = np.zeros(BITS, np.int64)
        for at in range(0, len(values), 1 << 15):
            some = _mixed(values[at : at + (1 << 15)], word)
            counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(values), bitorder="little").view(np.int64)[0]))
    return out


def word_names(words: int) -> list[str]:
    return ["__fp", *(f"__fp{k}" for k in range(1, words))]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int = 1, keep: bool = False) -> DataFrame:
    """id_col (or all columns) and the bigint columns word_names(words) of every row; null text: as empty."""
    source = docs if keep else docs.select(id_col, text_col)
    at = source.columns.index(text_col)
    first = source.schema if keep else docs.select(id_col).schema
    names = word_names(words)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in first), *(f"{n} bigint" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, at, 1 << 22):
            found = np.array([fingerprint(t, shingle, words) for t in texts], np.int64).T
            yield pa.RecordBatch.from_arrays([*(batch.columns if keep else [batch.column(0)]), *map(pa.array, found)], [*first.names, *names])

    return source.mapInArrow(run, schema)


@dataclass(frozen=True)
class Partition:
    mask: int  # the bits, signed
    bits: tuple[int, ...]
    threshold: int


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def group_bits(sample: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """The 64 bits in parts of near equal size; each grows from its first free bit by the bit most correlated with it."""
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1) if len(sample) else np.zeros((1, BITS))
    centred = bits.astype(float) - bits.mean(axis=0)
    spread = np.sqrt((centred**2).sum(axis=0))
    alike = np.abs(centred.T @ centred) / np.maximum(np.outer(spread, spread), 1e-9)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (alike[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        groups.append(tuple(sorted(group)))
    return groups


def allocate(sample: np.ndarray, total: int, radius: int) -> list[Partition]:
    """Partitions and thresholds of the least estimated cost for total fingerprints."""
    sample = sample[:1024]
    best: tuple[float, list[Partition]] | None = None
    for parts in range(min(2, radius + 1), radius + 2):
        groups = group_bits(sample, parts)
        costs = []
        for group in groups:
            mask = np.uint64(sum(1 << b for b in group))
            apart = np.bitwise_count((sample[:, None] ^ sample[None, :]) & mask) if len(sample) else np.zeros((0, 0))
            pairs = max(1, len(sample) * (len(sample) - 1))
            row = [0.0]
            for t in range(min(radius, 3) + 1):
                volume = sum(comb(len(group), j) for j in range(t + 1))
                share = max((int((apart <= t).sum()) - len(sample)) / pairs, volume / 2.0 ** len(group))
                # a row to shuffle and sort costs about as much as a hundred comparisons
                row.append(total * (1.0 if t == 0 else 1.0 + volume) + 0.01 * total * total / 2 * share)
            costs.append(row)
        # cheapest[k]: (cost, thresholds) of the groups so far with sum(t + 1) = k
        cheapest: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row in costs:
            further: dict[int, tuple[float, tuple[int, ...]]] = {}
            for k, (cost, chosen) in cheapest.items():
                for more, extra in enumerate(row):
                    if k + more <= radius + 1 and (k + more not in further or cost + extra < further[k + more][0]):
                        further[k + more] = cost + extra, (*chosen, more - 1)
            cheapest = further
        cost, thresholds = cheapest[radius + 1]
        if best is None or cost < best[0]:
            best = cost, [Partition(signed(sum(1 << b for b in g)), g, t) for g, t in zip(groups, thresholds) if t >= 0]
    return best[1]


def _row(part: int, key: F.Column, role: int) -> F.Column:
    return F.struct(F.lit(part).alias("part"), key.alias("key"), F.lit(role).alias("role"))


def _flipped(part: int, key: F.Column) -> Callable[[F.Column], F.Column]:
    return lambda flip: _row(part, key.bitwiseXOR(flip), 2)


def probes(partitions: list[Partition], fp: F.Column) -> F.Column:
    """Array of (part, key, role) of a fingerprint: role 1 is in the index, 2 probes it, 3 does both."""
    rows = []
    for i, p in enumerate(partitions):
        key = fp.bitwiseAND(F.lit(p.mask).cast("long"))
        if p.threshold == 0:
            rows.append(F.array(_row(i, key, 3)))
        else:
            flips = [signed(sum(1 << b for b in bits)) for t in range(p.threshold + 1) for bits in combinations(p.bits, t)]
            near = F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), _flipped(i, key))
            rows.append(F.concat(F.array(_row(i, key, 1)), near))
    return F.concat(*rows)


def link_buckets(bucket: np.ndarray, role: np.ndarray, words: list[np.ndarray], near: int, direct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Stars that join what is linked inside each bucket, direct: trees of links instead; rows sorted by bucket, those of the index first.

    Every index row is compared with every row after it in its bucket, all rows
    at once for each step; links inside what is joined already add nothing.
    """
    n = len(bucket)
    values = [w.view(np.uint64) for w in words]
    root = np.arange(n)
    edge = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    end = np.repeat(np.append(edge, n), np.diff([0, *edge, n])) if n else root
    left = np.flatnonzero((role & 1) > 0)
    tree: list[tuple[int, int]] = []
    step = 1
    while True:
        left = left[left + step < end[left]]
        if not len(left):
            break
        a, b = left, left + step
        bits = np.zeros(len(a), np.int64)
        for value in values:
            bits = bits + np.bitwise_count(value[a] ^ value[b])
            within = bits <= near
            a, b, bits = a[within], b[within], bits[within]
        own = a
        a, b = root[a], root[b]
        apart = a != b
        if apart.any():
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(up, up)
                return x

            for x, y, row in zip(a[apart].tolist(), b[apart].tolist(), own[apart].tolist()):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    tree.append((row, row + step))
            moved = np.arange(n)
            for x in list(parent):
                moved[x] = find(x)
            root = moved[root]
        step += 1
    fp = words[0]
    if direct:
        rows = np.array(tree, np.int64).reshape(-1, 2)
        a, b = fp[rows[:, 0]], fp[rows[:, 1]]
        return a[a != b], b[a != b]
    joined = np.flatnonzero((root != np.arange(n)) & (fp != fp[root]))
    return fp[joined], fp[root[joined]]


def _verified(rows: DataFrame, near: int, direct: bool) -> DataFrame:
    """Edges (a, b) between fingerprints: rows are (bucket, role, words of the fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(columns: list[np.ndarray]) -> pa.RecordBatch:
            a, b = link_buckets(columns[0], columns[1], columns[2:], near, direct)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            columns = [x.to_numpy() for x in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            if not len(columns[0]):
                continue
            # the last bucket may go on in the next batch
            whole = int(np.searchsorted(columns[0], columns[0][-1]))
            held = [c[whole:] for c in columns]
            if whole:
                yield out([c[:whole] for c in columns])
        if held is not None:
            yield out(held)

    return rows.repartition("bucket").sortWithinPartitions("bucket", "role", *rows.columns[2:]).mapInArrow(run, "a bigint, b bigint")


def links(values: DataFrame, radius: int, near: int | None = None, bucket_rows: int = BUCKET_ROWS, direct: bool = False) -> DataFrame:
    """Edges (a, b) that join exactly the fingerprints which chains of links join; values: distinct bigints __fp, further words after it.

    direct: every edge is a link itself, where else it may stand for a chain.
    Buckets of more than bucket_rows rows are split exactly: by equal groups of
    the bits outside their partition (one of radius + 1 groups must be equal),
    then, where that leaves large buckets, into blocks that meet in pairs.
    """
    if near is not None and near > radius:
        raise ValueError(f"near = {near} is beyond radius = {radius}: which pairs meet would depend on the partitions")
    words = values.columns
    total = values.count()
    sample = values.orderBy(F.xxhash64("__fp"), "__fp").select("__fp").limit(1024).toPandas()["__fp"].to_numpy(np.int64).view(np.uint64)
    partitions = allocate(sample, total, radius)
    fp = F.col("__fp")
    rows = (
        values.select(*words, F.explode(probes(partitions, fp)).alias("p"))
        .select(*words, "p.part", "p.role", F.xxhash64("p.part", "p.key").alias("bucket"))
        .withColumn("n", F.count("*").over(Window.partitionBy("bucket")))
    )
    usual = rows.where(F.col("n").between(2, bucket_rows))

    def rest(p: Partition) -> list[int]:
        others = [b for b in range(BITS) if b not in p.bits]
        return [signed(sum(1 << b for b in others[g :: radius + 1])) for g in range(radius + 1)]

    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in rest(p)]) for p in partitions])
    split = (
        rows.where(F.col("n") > bucket_rows)
        .select(*words, "role", "bucket", F.posexplode(F.element_at(masks, F.col("part") + 1)).alias("g", "mask"))
        .select(*words, "role", F.xxhash64("bucket", "g", fp.bitwiseAND(F.col("mask"))).alias("bucket"))
        .withColumn("n", F.count("*").over(Window.partitionBy("bucket")))
        .where("n > 1")
        .withColumn("blocks", F.ceil(F.col("n") / bucket_rows).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("__fp", "role"), F.col("blocks")).cast("int"))
        .select(*words, "role", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(*words, "role", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
    )
    return _verified(usual.select("bucket", "role", *words).union(split.select("bucket", "role", *words)), radius if near is None else near, direct)


def classes(signatures: DataFrame, id_col: str, radius: int, near: int | None = None) -> DataFrame:
    """__fp, root (a fingerprint that names the class) and component_id (its least id) of every distinct __fp.

    signatures: id_col, __fp and further words. Texts with equal __fp are one
    node, with the least of their further words.
    """
    more = signatures.columns[2:]
    found = signatures.groupBy("__fp").agg(F.min(id_col).alias("__least"), *(F.min(w).alias(w) for w in more))
    values = materialise(found, "fingerprints")
    found = components(links(values.select("__fp", *more), radius, near), "a", "b")
    joined = values.join(found, values["__fp"] == found["node"])
    named = joined.groupBy("root").agg(F.min("__least").alias("component_id"))
    linked = joined.join(named, "root").select("__fp", "root", "component_id")
    alone = values.join(found, values["__fp"] == found["node"], "left_anti").select("__fp", F.col("__fp").alias("root"), F.col("__least").alias("component_id"))
    return linked.union(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id of every row.

    component_id is the least id that chains of links reach. Null and empty
    texts have fingerprint zero and are linked like any other. A null id is no
    candidate for component_id (null if a class has no other). Repeated rows
    give a row each. Other columns are not used. No rows: no rows.
    """
    signatures = materialise(fingerprints(docs, id_col, text_col, shingle), "signatures")
    return signatures.join(classes(signatures, id_col, radius), "__fp").select(
        id_col, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """The rows of docs without all but one of each class of near-duplicates: the one of the least id stays.

    Two texts are linked if their shingle sets have a similarity (Jaccard) of
    at least similarity, by the exact sets. Those within radius bits of each
    other's fingerprint are found by links(); shingle_sets completes them, as
    texts of that similarity may be 16 to 18 bits apart. Rows are told apart by
    id and set. If a class's least id is that of several rows
    (repeated rows, null ids), one of them stays. Null and empty texts are
    near-duplicates of each other. Columns as in docs; names that clash with
    inner ones are given back at the end.
    """
    clashing = {c: f"kept {k} {c}" for k, c in enumerate(docs.columns) if c.lower().startswith("__") or c.lower() in ("root", "component_id", "fingerprint")}
    if clashing:
        own = keep_one(docs.withColumnsRenamed(clashing), clashing.get(id_col, id_col), clashing.get(text_col, text_col), shingle, similarity, radius)
        return own.withColumnsRenamed({v: k for k, v in clashing.items()})
    marked = materialise(shingle_sets.signatures(docs, text_col, shingle), "marked")
    found = shingle_sets.classes(marked, id_col, text_col, shingle, similarity, radius)
    own = marked.select(F.col(id_col).alias("__id"), "__key").join(found, "__key")
    # one id with several texts in a class: the least set
    least = own.where(F.col("__id").eqNullSafe(F.col("component_id"))).groupBy("root", "__id").agg(F.min("__key").alias("__kept"), F.count("*").alias("__rows"))
    joined = marked.join(least, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__kept")))
    single = joined.where("__rows = 1").select(*docs.columns)
    several = joined.where("__rows > 1").dropDuplicates(["root"]).select(*docs.columns)
    return single.union(several)

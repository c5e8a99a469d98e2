"""Writers: tables by Spark's writers, matrices of the doculects as text.

Matrices have a row for each doculect; their columns (cognate sets) are put
together by Spark, a string for each doculect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.table import number_rows


def flat(df: DataFrame) -> DataFrame:
    """df with lists blank-joined and doubles with four decimals, as text formats want them."""
    out = []
    for f in df.schema:
        kind = f.dataType.typeName()
        column = F.array_join(F.transform(f.name, lambda x: x.cast("string")), " ") if kind == "array" else F.format_string("%.4f", f.name) if kind in ("double", "float") else F.col(f.name).cast("string")
        out.append(F.coalesce(column, F.lit("")).alias(f.name.upper()))
    return df.select(*out)


def write_wordlist(df: DataFrame, path: str, order: str = "concept") -> None:
    """Tab-separated parts with a header, ordered by a column; text cells lose tabs."""
    flat(df.orderBy(order)).write.csv(path, sep="\t", header=True, quote="")


def write_cldf(df: DataFrame, folder: str) -> None:
    """The tables forms, languages, parameters and cognates, joined by slugs, as folders of CSV parts."""
    slug = lambda c: F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]+", ""))
    write = lambda d, name: d.write.csv(f"{folder}/{name}", header=True)
    write(df.select(F.col("id").alias("ID"), slug("doculect").alias("Language_ID"), slug("concept").alias("Parameter_ID"), F.col("form").alias("Form")), "forms")
    write(df.select(slug("doculect").alias("ID"), F.col("doculect").alias("Name")).distinct(), "languages")
    write(df.select(slug("concept").alias("ID"), F.col("concept").alias("Name")).distinct(), "parameters")
    write(df.select(F.col("id").alias("ID"), F.col("id").alias("Form_ID"), F.col("cogid").alias("Cognateset_ID")), "cognates")


def phylip(distances: DataFrame, width: int = 10) -> str:
    """A matrix of a, b, distance (one half is enough) as PHYLIP text."""
    d = {(r["a"], r["b"]): r["distance"] for r in distances.collect()}
    names = sorted({x for pair in d for x in pair})
    cell = lambda a, b: 0.0 if a == b else d.get((a, b), d.get((b, a), 0.0))
    return "\n".join([f" {len(names)}", *(f"{a[:width]:<{width}} " + " ".join(f"{cell(a, b):.4f}" for b in names) for a in names)]) + "\n"


def state_rows(paps: DataFrame, ref: str = "cogid", missing: str = "?") -> DataFrame:
    """doculect and its states as one string, sets in their order; paps: ref, doculect, state (below 0: missing)."""
    sets = number_rows(paps.select(F.col(ref).alias("ref")).distinct(), ["ref"], name="k")
    symbol = F.when(F.col("state") < 0, missing).otherwise(F.col("state").cast("string"))
    cells = paps.join(sets, F.col(ref) == F.col("ref")).select("doculect", "k", symbol.alias("s"))
    rows = cells.groupBy("doculect").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("c"))
    return rows.select("doculect", F.array_join(F.transform("c", lambda c: c["s"]), "").alias("states"))


def nexus(rows: DataFrame, datatype: str = "STANDARD", symbols: str = "01", missing: str = "?", gap: str = "-", commands: list[str] | None = None, ascertain: bool = False) -> str:
    """A NEXUS block of doculects and their states; with ascertain a first column of absences, as BEAST wants it."""
    data = {r["doculect"].replace(" ", "_"): ("0" if ascertain else "") + r["states"] for r in rows.orderBy("doculect").collect()}
    width = max(map(len, data), default=0) + 2
    chars = len(next(iter(data.values()), ""))
    lines = ["#NEXUS", "", "BEGIN DATA;", f"DIMENSIONS NTAX={len(data)} NCHAR={chars};", f'FORMAT DATATYPE={datatype} SYMBOLS="{symbols}" MISSING={missing} GAP={gap};', "MATRIX"]
    lines += [f"{name:<{width}}{states}" for name, states in data.items()]
    lines += [";", "END;"]
    if commands:
        lines += ["", "BEGIN MRBAYES;", *(f"{c};" for c in commands), "END;"]
    return "\n".join(lines) + "\n"


def without_constant(paps: DataFrame, ref: str = "cogid") -> DataFrame:
    """paps without the sets that have one state in all doculects."""
    varied = paps.groupBy(F.col(ref).alias("ref")).agg(F.count_distinct(F.when(F.col("state") >= 0, F.col("state"))).alias("kinds")).where("kinds > 1").select("ref")
    return paps.join(varied, F.col(ref) == F.col("ref"), "left_semi")


def gml(nodes: DataFrame, edges: DataFrame) -> str:
    """A graph of concepts (concept and counts) and edges (a, b and weights) as GML text."""
    ids, lines = {}, ["graph ["]
    for k, r in enumerate(nodes.orderBy("concept").collect()):
        ids[r["concept"]] = k
        lines += ["  node [", f"    id {k}", f'    label "{r["concept"]}"', *(f"    {c} {r[c]}" for c in nodes.columns if c != "concept"), "  ]"]
    for r in edges.orderBy("a", "b").collect():
        lines += ["  edge [", f"    source {ids[r['a']]}", f"    target {ids[r['b']]}", *(f"    {c} {r[c]}" for c in edges.columns if c not in ("a", "b")), "  ]"]
    return "\n".join([*lines, "]"]) + "\n"


def alignment_text(aligned: DataFrame, ref: str, value) -> str:
    """The alignment of one set as text: a name and its segments in each row."""
    rows = aligned.where(F.col(ref) == value).orderBy("doculect", "id").select("doculect", "alignment").collect()
    width = max((len(r["doculect"]) for r in rows), default=0)
    return "\n".join([str(value), str(value), *(f"{r['doculect']:.<{width}}\t" + "\t".join(r["alignment"]) for r in rows)]) + "\n"

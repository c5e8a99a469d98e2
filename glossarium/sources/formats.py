"""Readers of wordlists, alignments, matrices and linked tables.

Tables are read by Spark's readers with explicit schemas. Small headers and
matrices (a line for each doculect or symbol) are parsed from text columns.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that columns of wordlists go by, and the kind of their values.
ALIASES = {
    "doculect": ("doculect", "language", "taxon", "taxa", "languoid"),
    "concept": ("concept", "gloss", "meaning", "parameter"),
    "form": ("form", "ipa", "counterpart", "transcription", "orthography"),
    "tokens": ("tokens", "segments", "tokenized_counterpart"),
    "cogid": ("cogid", "cognateset_id", "cognate_id", "cogids"),
    "alignment": ("alignment", "alignments"),
}
KINDS = {"cogid": "int", "tokens": "strings", "alignment": "strings", "crossids": "ints", "partial_ids": "ints", "weights": "floats", "duplicates": "int", "concept_id": "int"}


def canonical(name: str) -> str:
    name = name.strip().lower()
    return next((k for k, names in ALIASES.items() if name in names), name)


def cast(column: Column, kind: str) -> Column:
    """A cell of text as a value; what does not fit is null (a list: without it). An empty int is 0."""
    if kind == "int":
        return F.coalesce(F.when(F.trim(column) == "", F.lit(0)).otherwise(F.expr("null")), column.try_cast("bigint"))
    items = F.filter(F.split(F.trim(column), r"\s+"), lambda x: x != "")
    if kind == "strings":
        return items
    if kind == "ints":
        return F.filter(F.transform(items, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())
    if kind == "floats":
        return F.filter(F.transform(items, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return column


def read_wordlist(spark: SparkSession, path: str, sep: str = "\t", comment: str = "#", kinds: dict[str, str] | None = None) -> DataFrame:
    """A wordlist from a table with a header: canonical column names, typed values, an id.

    Lines of comments and of metadata (@ and < at the start) are not rows. A
    first column named id holds ids; without one, lines are numbered. Cells
    that do not fit their kind keep their text in the column name_text.
    """
    text = spark.read.text(path).where(~F.col("value").rlike(rf"^\s*($|[@<{comment}])"))
    header = text.first()["value"].split(sep)
    if len(set(map(canonical, header))) < len(header):
        raise ValueError(f"two columns of one name: {header}")
    cells = F.split("value", sep, -1)
    rows = text.where(F.col("value") != sep.join(header)).withColumn("c", cells)
    width = rows.agg(F.max(F.when(F.size("c") != len(header), F.col("value")))).first()[0]
    if width is not None:
        raise ValueError(f"a row with other than {len(header)} cells: {width[:100]}")
    out, kinds = [], KINDS | (kinds or {})
    own_id = header[0].strip().lower() in ("id", "local_id", "localid")
    out.append((F.get("c", 0).try_cast("bigint") if own_id else F.monotonically_increasing_id() + 1).alias("id"))
    for i, name in enumerate(header):
        if own_id and i == 0:
            continue
        name, cell = canonical(name), F.get("c", i)
        kind = kinds.get(name, "string")
        value = cast(cell, kind)
        out.append(value.alias(name))
        if kind == "int":
            out.append(F.when(value.isNull(), cell).alias(f"{name}_text"))
    return rows.select(*out)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """key and value of the lines "@key:value" of a wordlist file, repeated keys a row each."""
    lines = spark.read.text(path).where(F.col("value").startswith("@"))
    return lines.select(F.regexp_extract("value", r"^@([^:]+):", 1).alias("key"), F.trim(F.regexp_replace("value", r"^@[^:]+:", "")).alias("value"))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """dataset, sequence, taxon and alignment of files of aligned blocks: two lines of names, then a row for each taxon.

    Taxon names may be padded with dots; rows LOCAL, SWAPS, CROSSED, MERGE and
    COMPLEX are marks and stay with their names.
    """
    files = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    rows = files.select(F.get(lines, 0).alias("dataset"), F.get(lines, 1).alias("sequence"), F.posexplode(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))).alias("row", "line"))
    cells = F.split(F.trim("line"), r"\t")
    return rows.select("dataset", "sequence", "row", F.regexp_replace(F.get(cells, 0), r"\.+$", "").alias("taxon"), F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))).alias("alignment"))


def read_distances(spark: SparkSession, path: str, width: int = 10) -> DataFrame:
    """a, b and distance of a PHYLIP matrix: a line with the number of taxa, then names (tab or width characters) and rows."""
    lines = [r["value"] for r in spark.read.text(path).collect() if r["value"].strip() and not r["value"].startswith("#")]
    names, rows = [], []
    for line in lines[1:]:
        name, rest = line.split("\t", 1) if "\t" in line else (line[:width], line[width:])
        names.append(name.strip())
        rows.append([float(x) for x in rest.split()])
    return spark.createDataFrame([(a, b, d) for a, row in zip(names, rows) for b, d in zip(names, row)], "a string, b string, distance double")


def read_scorer(spark: SparkSession, path: str) -> DataFrame:
    """a, b and score of a square table: a symbol and its scores in each line, in the same order."""
    lines = [r["value"].rstrip("\n").split("\t") for r in spark.read.text(path).collect() if r["value"].strip()]
    symbols = [x[0] for x in lines]
    return spark.createDataFrame([(a, b, float(s)) for a, *row in lines for b, s in zip(symbols, row)], "a string, b string, score double")


def read_starling(spark: SparkSession, path: str) -> DataFrame:
    """A long wordlist from a wide one: Number, Word, then for each language its forms and, under "language #", their sets.

    A set of 0 leaves the form out; sets are made global by the concept, and
    negative ones (loans) get a set of their own. "form {spelling}" keeps both.
    """
    wide = spark.read.csv(path, sep="\t", header=True)
    languages = [c for c in wide.columns[2:] if not c.endswith(" #")]
    cells = F.array(*[F.struct(F.lit(c).alias("doculect"), F.col(f"`{c}`").alias("cell"), F.col(f"`{c} #`").try_cast("bigint").alias("cog")) for c in languages])
    rows = wide.select(F.col(wide.columns[0]).try_cast("bigint").alias("number"), F.col(wide.columns[1]).alias("concept"), F.explode(cells).alias("x"))
    rows = rows.where("x.cog is not null and x.cog <> 0 and trim(x.cell) <> ''")
    form = F.trim(F.regexp_replace("x.cell", r"\{.*\}", ""))
    cogid = F.when(F.col("x.cog") > 0, F.concat_ws(":", "concept", F.col("x.cog").cast("string"))).otherwise(F.concat_ws(":", "concept", "x.doculect", F.col("x.cog").cast("string")))
    return rows.select("x.doculect", "concept", form.alias("form"), F.regexp_extract("x.cell", r"\{(.*)\}", 1).alias("orthography"), cogid.alias("cogid"))


def read_cldf(spark: SparkSession, folder: str, concept: str = "Name", language: str = "Name") -> DataFrame:
    """Forms with the names of their languages and concepts, and their cognate sets where there are some."""
    meta = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/*-metadata.json").collect()))
    if not str(meta.get("dc:conformsTo", "")).endswith("Wordlist"):
        raise ValueError("not a wordlist")
    read = lambda name: spark.read.csv(f"{folder}/{name}.csv", header=True, quote='"', escape='"')
    forms, languages, parameters, cognates = read("forms"), read("languages"), read("parameters"), read("cognates")
    joined = (
        forms.join(languages.select(F.col("ID").alias("Language_ID"), F.col(language).alias("doculect")), "Language_ID", "left")
        .join(parameters.select(F.col("ID").alias("Parameter_ID"), F.col(concept).alias("concept")), "Parameter_ID", "left")
        .join(cognates.select(F.col("Form_ID").alias("ID"), F.col("Cognateset_ID").alias("cogid"), F.col("Alignment").alias("alignment")), "ID", "left")
    )
    return joined.select("ID", "doculect", "concept", F.col("Form").alias("form"), F.split("Segments", " ").alias("tokens"), "cogid", F.split("alignment", " ").alias("alignment"))

"""Table operators: numbering, slots, cognate sets, presence patterns, coverage and distances.

A wordlist has a row per word: id (bigint), doculect, concept, form and cogid.
Doculects and concepts are dimension-sized; nothing here gathers words to the
driver, and pairs of words are never made where counts of sets will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Symbols for states in multistate output, in order.
STATES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def number_rows(df: DataFrame, order: list[str], leading: int = 1, name: str = "id") -> DataFrame:
    """df with its rows numbered from 1 in the given order, without one global sort.

    Rows are ranked within the first leading columns of the order; the groups'
    sizes are summed in order, which takes one row for each group.
    """
    keys, rest = order[:leading], order[leading:]
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys).agg(F.count("*").alias("__n")).select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(rest or keys)))
    numbered = df.withColumn("__rank", rank).join(starts, keys)
    return numbered.select((F.col("__before") + F.col("__rank")).cast("long").alias(name), *df.columns)


def renumber(df: DataFrame, source: str, target: str) -> DataFrame:
    """df with target: the place of source (as a string) among its distinct values in string order; '' is 0 but takes a place."""
    values = df.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__v")).distinct()
    numbered = number_rows(values.withColumn("__first", F.substring("__v", 1, 2)), ["__first", "__v"], name=target)
    numbered = numbered.select("__v", F.when(F.col("__v") == "", F.lit(0)).otherwise(F.col(target)).cast("long").alias(target))
    return df.join(numbered, F.coalesce(F.col(source).cast("string"), F.lit("")) == F.col("__v")).select(*df.columns, target)


def slots(df: DataFrame) -> DataFrame:
    """df with slot: the number (from 1) of the synonym within its doculect and concept."""
    return df.withColumn("slot", F.row_number().over(Window.partitionBy("concept", "doculect").orderBy("id")))


def pivot_entries(df: DataFrame, entry: str) -> DataFrame:
    """A row for each concept and slot, a column for each doculect: the matrix of a wordlist, null where there is no word."""
    return slots(df).groupBy("concept", "slot").pivot("doculect").agg(F.min(entry))


def triples(df: DataFrame, columns: list[str]) -> DataFrame:
    """(id, column, value) for every cell that is not empty, values as strings."""
    cells = df.select("id", *[F.col(c).cast("string") for c in columns])
    return cells.unpivot("id", columns, "column", "value").where("value is not null and value <> ''")


def from_triples(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table of (id, column, value): a column for each name, '' where a cell is missing; of several values the greatest."""
    return df.groupBy("id").pivot("column", columns).agg(F.max("value")).na.fill("")


def clean_doculects(df: DataFrame, column: str = "doculect") -> DataFrame:
    """df with brackets, commas, colons and semicolons taken out of column, and - and blank as _."""
    return df.withColumn(column, F.translate(F.regexp_replace(column, r"[()\[\]{},;:]", ""), "- ", "__"))


def coverage(df: DataFrame) -> DataFrame:
    """doculect, concepts it has words for (absolute) and their share in all concepts (ratio)."""
    height = df.agg(F.count_distinct("concept").alias("height"))
    per = df.groupBy("doculect").agg(F.count_distinct("concept").alias("absolute"))
    return per.join(F.broadcast(height)).select("doculect", "absolute", (F.col("absolute") / F.col("height")).alias("ratio"))


def synonymy(df: DataFrame) -> DataFrame:
    """Words for each doculect and concept."""
    return df.groupBy("doculect", "concept").agg(F.count("*").alias("words"))


def doculect_pairs(df: DataFrame) -> DataFrame:
    """Every two doculects (a < b): as many rows as the dimension has pairs."""
    names = df.select("doculect").distinct()
    a, b = names.select(F.col("doculect").alias("a")), names.select(F.col("doculect").alias("b"))
    return a.join(b, F.col("a") < F.col("b"))


def mutual_coverage(df: DataFrame) -> DataFrame:
    """Concepts that both doculects of a pair have, for every pair."""
    has = df.select("doculect", "concept").distinct()
    a, b = has.select(F.col("doculect").alias("a"), "concept"), has.select(F.col("doculect").alias("b"), "concept")
    both = a.join(b, "concept").where("a < b").groupBy("a", "b").agg(F.count("*").alias("concepts"))
    return doculect_pairs(df).join(both, ["a", "b"], "left").na.fill(0, ["concepts"])


def average_coverage(df: DataFrame) -> DataFrame:
    """Mean mutual coverage of the pairs, as a share of all concepts (one row)."""
    height = df.agg(F.count_distinct("concept").alias("height"))
    mean = mutual_coverage(df).agg(F.avg("concepts").alias("mean"))
    return mean.join(F.broadcast(height)).select((F.col("mean") / F.col("height")).alias("average_coverage"))


def diversity(df: DataFrame, ref: str = "cogid") -> DataFrame:
    """(cognate sets - concepts) / (words - concepts), one row."""
    counts = df.agg(F.count_distinct(ref).alias("sets"), F.count_distinct("concept").alias("height"), F.count("*").alias("words"))
    return counts.select("sets", "height", "words", ((F.col("sets") - F.col("height")) / (F.col("words") - F.col("height"))).alias("diversity"))


def etymdict(df: DataFrame, ref: str = "cogid", modify: Column | None = None) -> DataFrame:
    """For each cognate set and doculect the ids of its words, in order, blank-separated; list-valued refs count with each element."""
    key = F.col(ref) if modify is None else modify
    rows = df.select("id", "doculect", F.explode(ref).alias(ref)) if df.schema[ref].dataType.typeName() == "array" else df
    ids = F.array_sort(F.collect_list("id"))
    return rows.groupBy(key.alias(ref), "doculect").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("ids"))


def paps(df: DataFrame, ref: str = "cogid", missing: int = 0) -> DataFrame:
    """Presence (1), absence (0) or missing of every cognate set in every doculect.

    Absent is missing where the doculect has no word for the set's one meaning;
    a set of more than one meaning counts as present everywhere.
    """
    has = df.select(F.col(ref).alias("ref"), "doculect").distinct().withColumn("present", F.lit(1))
    meanings = df.groupBy(F.col(ref).alias("ref")).agg(F.count_distinct("concept").alias("meanings"), F.min("concept").alias("concept"))
    covered = df.select("doculect", "concept").distinct().withColumn("covered", F.lit(True))
    taxa = df.select("doculect").distinct()
    # every set meets every doculect: the size of the result
    states = meanings.join(F.broadcast(taxa)).join(has, ["ref", "doculect"], "left").join(F.broadcast(covered), ["doculect", "concept"], "left")
    state = F.when(F.col("present").isNotNull() | (F.col("meanings") > 1), 1).when(F.col("covered").isNull(), missing).otherwise(0)
    return states.select(F.col("ref").alias(ref), "doculect", state.cast("int").alias("state"))


def distance_swadesh(df: DataFrame, ref: str = "cogid", ignore_missing: bool = False) -> DataFrame:
    """1 - shared / compared for every two doculects; compared are the concepts both have (all with ignore_missing), none: 1.0."""
    has = df.select("doculect", "concept", F.col(ref).alias("ref")).distinct()
    a = has.select(F.col("doculect").alias("a"), "concept", "ref")
    b = has.select(F.col("doculect").alias("b"), "concept", "ref")
    # a concept counts once, however many of its words two doculects share
    shared = a.join(b, ["concept", "ref"]).where("a < b").select("a", "b", "concept").distinct().groupBy("a", "b").agg(F.count("*").alias("shared"))
    compared = mutual_coverage(df)
    if ignore_missing:
        height = df.agg(F.count_distinct("concept").alias("height"))
        compared = compared.join(F.broadcast(height)).select("a", "b", F.col("height").alias("concepts"))
    distance = F.when(F.col("concepts") == 0, 1.0).otherwise(1 - F.coalesce("shared", F.lit(0)) / F.col("concepts"))
    return compared.join(shared, ["a", "b"], "left").select("a", "b", distance.alias("distance"))


def distance_jaccard(df: DataFrame, ref: str = "cogid") -> DataFrame:
    """1 - intersection / union of the cognate sets of two doculects; a doculect with gaps in its slots has the gap as one more set."""
    sets = df.select("doculect", F.col(ref).alias("ref")).distinct()
    sizes = sets.groupBy("doculect").agg(F.count("*").alias("size"))
    words = df.groupBy("doculect", "concept").agg(F.count("*").alias("n"))
    rows = words.groupBy("concept").agg(F.max("n").alias("rows"))
    full = rows.agg(F.sum("rows").alias("cells"))
    # a gap: fewer words than the concepts have rows in all
    gaps = df.groupBy("doculect").agg(F.count("*").alias("words")).join(F.broadcast(full))
    sizes = sizes.join(gaps, "doculect").select("doculect", "size", (F.col("words") < F.col("cells")).alias("gap"))
    a, b = sets.select(F.col("doculect").alias("a"), "ref"), sets.select(F.col("doculect").alias("b"), "ref")
    common = a.join(b, "ref").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    named = lambda x: sizes.select(F.col("doculect").alias(x), F.col("size").alias(f"size_{x}"), F.col("gap").alias(f"gap_{x}"))
    joined = doculect_pairs(df).join(named("a"), "a").join(named("b"), "b").join(common, ["a", "b"], "left").na.fill(0, ["common"])
    union = F.col("size_a") + F.col("size_b") - F.col("common") + (F.col("gap_a") | F.col("gap_b")).cast("int")
    return joined.select("a", "b", (1 - F.col("common") / union).alias("distance"))


def shared_words(df: DataFrame, ref: str = "cogid") -> DataFrame:
    """For a <= b: words of a whose cognate set b has too (a = b: the words of a)."""
    counts = df.groupBy("doculect", F.col(ref).alias("ref")).agg(F.count("*").alias("n"))
    a = counts.select(F.col("doculect").alias("a"), "ref", "n")
    b = counts.select(F.col("doculect").alias("b"), "ref")
    found = a.join(b, "ref").where("a <= b").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    own = df.select(F.col("doculect").alias("a"), F.col("doculect").alias("b")).distinct()
    return doculect_pairs(df).union(own).join(found, ["a", "b"], "left").na.fill(0, ["shared"])


def multistate(df: DataFrame, ref: str = "cogid", missing: str = "-") -> DataFrame:
    """The states of every doculect for every concept: the symbols of its cognate sets, in brackets if several.

    Symbols follow the order of the concept's sets; if a doculect has no word
    for the concept, the first symbol stands for that. Sets beyond the 62
    symbols have their number in angle brackets, so that no two look alike.
    """
    sets = df.select("concept", "doculect", F.col(ref).alias("ref")).distinct()
    taxa = df.select("doculect").distinct()
    width = taxa.agg(F.count("*").alias("width"))
    gaps = sets.groupBy("concept").agg(F.count_distinct("doculect").alias("n")).join(F.broadcast(width)).select("concept", (F.col("n") < F.col("width")).cast("int").alias("gap"))
    ranked = sets.withColumn("rank", F.dense_rank().over(Window.partitionBy("concept").orderBy("ref"))).join(gaps, "concept")
    place = F.col("rank") + F.col("gap")
    symbol = F.when(place <= len(STATES), F.substring(F.lit(STATES), place, F.lit(1))).otherwise(F.concat(F.lit("<"), place.cast("string"), F.lit(">")))
    cells = ranked.groupBy("concept", "doculect").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), symbol.alias("symbol")))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["symbol"]), "")
    states = cells.select("concept", "doculect", F.when(F.size("s") == 1, text).otherwise(F.concat(F.lit("("), text, F.lit(")"))).alias("states"))
    grid = df.select("concept").distinct().join(F.broadcast(taxa))
    return grid.join(states, ["concept", "doculect"], "left").na.fill(missing, ["states"])


def duplicates(df: DataFrame, entry: str = "form") -> DataFrame:
    """df with duplicate: 1 for the later words of a doculect that have the same entry."""
    rank = F.row_number().over(Window.partitionBy("doculect", entry).orderBy("id"))
    return df.withColumn("duplicate", (rank > 1).cast("int"))


def word_pairs(df: DataFrame, entry: str = "form") -> DataFrame:
    """Pairs of words of different doculects (a < b) for the same concept, each two entries once for two doculects and a concept.

    Words are compared only within a concept (the join key); equal entries of a
    doculect are taken together before the join, which is what keeps a concept
    with many synonyms from squaring.
    """
    one = df.groupBy("concept", "doculect", F.col(entry).alias("entry")).agg(F.min("id").alias("id"))
    a = one.select("concept", F.col("doculect").alias("a"), F.col("id").alias("id_a"), F.col("entry").alias("entry_a"))
    b = one.select("concept", F.col("doculect").alias("b"), F.col("id").alias("id_b"), F.col("entry").alias("entry_b"))
    pairs = a.join(b, "concept").where("a < b")
    # the same two entries of two doculects under several concepts: the pair of the first word stays; minima of numbers are hashed before the shuffle
    first = pairs.groupBy("a", "b", "entry_a", "entry_b").agg(F.min("id_a").alias("id_a"))
    found = first.join(one.select(F.col("id").alias("id_a"), "concept"), "id_a").join(b, ["concept", "b", "entry_b"])
    return found.select("concept", "a", "id_a", "entry_a", "b", "id_b", "entry_b")


def check_duplicate_ids(df: DataFrame, ref: str) -> DataFrame:
    """Rows whose list of cognate ids has an id twice."""
    return df.where(F.size(F.array_distinct(ref)) != F.size(ref))


def check_lengths(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two list columns differ in length."""
    return df.where(F.size(a) != F.size(b))


def check_strict_cognates(df: DataFrame, ref: str = "cogid", entry: str = "form") -> DataFrame:
    """Doculects and cognate sets with more than one form, and how many."""
    return df.groupBy("doculect", ref).agg(F.count_distinct(entry).alias("forms")).where("forms > 1")


def concept_subset(df: DataFrame, concepts: DataFrame) -> DataFrame:
    """The rows for the concepts of another table."""
    return df.join(concepts.select("concept").distinct(), "concept", "left_semi")


def largest_coverage_group(df: DataFrame, threshold: int) -> DataFrame:
    """The doculects of the largest group in which every two share at least threshold concepts (a row each; ties: first in order).

    The pairs, as many as the dimension has, come to the driver; the search is
    for a largest clique (Bron and Kerbosch, with pivots).
    """
    rows = mutual_coverage(df).where(F.col("concepts") >= threshold).select("a", "b").collect()
    names = sorted(r["doculect"] for r in df.select("doculect").distinct().collect())
    near: dict[str, set[str]] = {n: set() for n in names}
    for r in rows:
        near[r["a"]].add(r["b"])
        near[r["b"]].add(r["a"])
    best: list[str] = []
    todo: list[tuple[list[str], set[str], set[str]]] = [([], set(names), set())]
    while todo:
        clique, free, done = todo.pop()
        if not free and not done:
            if (-len(clique), sorted(clique)) < (-len(best), best) or not best:
                best = sorted(clique)
            continue
        pivot = max(free | done, key=lambda x: (len(near[x] & free), x))
        for x in sorted(free - near[pivot]):
            todo.append(([*clique, x], free & near[x], done & near[x]))
            free, done = free - {x}, done | {x}
    spark = df.sparkSession
    return spark.createDataFrame([(x,) for x in best], "doculect string")

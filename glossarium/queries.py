"""Queries over the driver's tables, one for each operator or family, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import generate as ge
from .functions import ngrams as ng
from .functions import smoothing as sm
from .functions import sounds as so
from .functions import strings as st
from .operators import alignments as am
from .operators import cognates as cg
from .operators import evaluation as ev
from .operators import lexstat as ls
from .operators import linkage as lk
from .operators import multiple as mu
from .operators import networks as nw
from .operators import phylogeny as ph
from .operators import table as tb
from .operators.graphs import kept
from .plans.views import WORDLIST_SQL, wordlist
from .sources import writers as wr

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it, its SQL over the view wl."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = f"WITH {WORDLIST_SQL}{sql}"
        return f

    return add


def _form_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two forms that occur for one concept, once; metrics are worked out on these and not on pairs of words."""
    forms = wordlist(spark, sf_dir).select("concept", "form").distinct()
    a, b = forms.withColumnRenamed("form", "form_a"), forms.withColumnRenamed("form", "form_b")
    pairs = a.join(b, "concept").where("form_a < form_b").select("form_a", "form_b").distinct()
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return pairs.withColumn("a", chars("form_a")).withColumn("b", chars("form_b"))


#: The same pairs in SQL, with the characters, neighbours and triples of both forms.
_PAIRS_SQL = """, f AS (SELECT DISTINCT concept, form FROM wl),
p AS (SELECT DISTINCT x.form AS form_a, y.form AS form_b FROM f x JOIN f y ON x.concept = y.concept AND x.form < y.form),
g AS (SELECT form_a, form_b, length(form_a) AS la, length(form_b) AS lb,
  list_transform(range(1, length(form_a)), lambda i: form_a[i:i+1]) AS a2, list_transform(range(1, length(form_b)), lambda i: form_b[i:i+1]) AS b2,
  list_transform(range(1, length(form_a) - 1), lambda i: form_a[i:i+2]) AS a3, list_transform(range(1, length(form_b) - 1), lambda i: form_b[i:i+2]) AS b3,
  list_transform(range(1, length(form_a) - 1), lambda i: form_a[i:i] || form_a[i+2:i+2]) AS ax, list_transform(range(1, length(form_b) - 1), lambda i: form_b[i:i] || form_b[i+2:i+2]) AS bx
  FROM p)"""


def _common_sql(x: str, y: str) -> str:
    times = lambda z: f"len(list_filter({z}, lambda e: e = t))"
    return f"coalesce(list_sum(list_transform(list_distinct(list_intersect({x}, {y})), lambda t: least({times(x)}, {times(y)}))), 0)"


def _metric(metric: str, expression: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _form_pairs(spark, sf_dir).select("form_a", "form_b", F.round(st.METRICS[metric](F.col("a"), F.col("b")), 9).alias("distance"))

    sql = None if expression is None else f"{_PAIRS_SQL} SELECT form_a, form_b, round(({expression})::DOUBLE, 9) AS distance FROM g"
    query(sql, f"metric_{metric}")(run)


_metric("ldn", "levenshtein(form_a, form_b) / greatest(la, lb)")
_metric("jcdn", None)  # of no use but to give known results: tests hold it against brute force
_metric("dice", f"1 - 2 * {_common_sql('a2', 'b2')} / (la + lb - 2)")
_metric("jcd", f"1 - {_common_sql('a2', 'b2')} / (la + lb - 2 - {_common_sql('a2', 'b2')})")
_metric("xdice", f"1 - 2 * {_common_sql('ax', 'bx')} / (la + lb - 4)")
_metric("trigram", f"1 - 2 * {_common_sql('a3', 'b3')} / (la + lb - 4)")
_metric("prefix", "1 - len(list_filter(range(1, least(la, lb) + 1), lambda i: form_a[i:i] = form_b[i:i])) / greatest(la, lb)")
_metric("xxdice", "1 - 2 * list_sum(list_transform(range(1, la), lambda i: list_sum(list_transform(range(1, lb), lambda j: CASE WHEN form_a[i:i+1] = form_b[j:j+1] THEN 1.0 / (1 + (i - j) * (i - j)) ELSE 0 END)))) / (la + lb - 2)")


def _folded_sql(border: str, cell: str, state: str = "{row}") -> str:
    """A matrix over the lists ga (rows) and gb in SQL, row by row: elements and rows are lists of doubles, as list_reduce asks for one type.

    cell knows left, above, corner, x, y, i and j; state is what a row hands on.
    """
    names = {"left": "r[len(r)]", "above": "prev[j[1]::INT + 1]", "corner": "prev[j[1]::INT]", "x": "ga[i[1]::INT]", "y": "gb[j[1]::INT]", "i": "i[1]::INT", "j": "j[1]::INT", "before_x": "ga[i[1]::INT - 1]", "before_y": "gb[j[1]::INT - 1]", "past": "prev[len(gb) + j[1]::INT]"}
    places = lambda g, k: f"list_transform(range(1, len({g}) + 1), lambda {k}: [{k}::DOUBLE])"
    row = f"list_reduce(list_prepend([{border.format(k='i[1]')}::DOUBLE], {places('gb', 'q')}), lambda r, j: list_append(r, ({cell.format(**names)})::DOUBLE))"
    top = f"list_transform(range(0, len(gb) + 1), lambda q: {border.format(k='q')}::DOUBLE)"
    return f"list_reduce(list_prepend({state.format(row=top)}, {places('ga', 'q')}), lambda prev, i: {state.format(row=row)})[len(gb) + 1]"


def _matrix_metric(metric: str, order: int, leave: int, value: str, longer: str) -> None:
    """A metric of matrices over the n-grams of an order, the last ones (leave) left out."""
    pads = "-" * (order - 1)
    grams = lambda c, n: f"list_transform(range(1, {n} + {order - leave}), lambda q: ('{pads}' || {c} || '{pads}')[q:q+{order - 1}])"
    sql = f"{_PAIRS_SQL}, h AS (SELECT form_a, form_b, la, lb, {grams('form_a', 'la')} AS ga, {grams('form_b', 'lb')} AS gb FROM g) SELECT form_a, form_b, round({value.format(longer=longer)}, 9) AS distance FROM h"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _form_pairs(spark, sf_dir).select("form_a", "form_b", F.round(st.METRICS[metric](F.col("a"), F.col("b")), 9).alias("distance"))

    query(sql, f"metric_{metric}")(run)


_LCS_SQL = _folded_sql("0", "greatest({left}, {above}, {corner} + ({x} = {y})::INT)")
_SWAP_SQL = _folded_sql(
    "{k}",
    "least({left} + 1, {above} + 1, {corner} + ({x} <> {y})::INT, CASE WHEN {i} > 1 AND {j} > 1 AND {x} = {before_y} AND {before_x} = {y} THEN {past} + 1 ELSE 1e9 END)",
    "list_concat({row}, prev[1:len(gb) + 1])",
).replace("list_prepend(list_concat(list_transform(range(0, len(gb) + 1), lambda q: q::DOUBLE), prev[1:len(gb) + 1])", "list_prepend(list_transform(range(0, len(gb) + 1), lambda q: q::DOUBLE)")
_matrix_metric("lcs", 1, 0, f"1 - {_LCS_SQL} / {{longer}}", "greatest(la, lb)")
_matrix_metric("ldn_swap", 1, 0, f"{_SWAP_SQL} / {{longer}}", "greatest(la, lb)")
for _order, _prefix in ((2, "bi"), (3, "tri")):
    _places = f"range(1, {_order + 1})"
    for _k, _common in enumerate(
        (
            "({x} = {y})::INT",
            f"len(list_filter({_places}, lambda k: contains({{y}}, ({{x}})[k:k]))) / {_order}",
            f"len(list_filter({_places}, lambda k: ({{x}})[k:k] = ({{y}})[k:k])) / {_order}",
        ),
        1,
    ):
        _cost = _folded_sql("{k}", f"least({{left}} + 1, {{above}} + 1, {{corner}} + 1 - {_common})")
        _best = _folded_sql("0", f"greatest({{left}}, {{above}}, {{corner}} + {_common})")
        _matrix_metric(f"{_prefix}dist{_k}", _order, int(_k > 1), f"{_cost} / {{longer}}", "greatest(len(ga), len(gb))")
        _matrix_metric(f"{_prefix}sim{_k}", _order, _order - 1, f"1 - {_best} / {{longer}}", "greatest(la, lb)")


@query(" SELECT * FROM wl")
def wl_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordlist(spark, sf_dir)


_TAXA_SQL = """, taxa AS (SELECT DISTINCT doculect FROM wl),
pairs AS (SELECT x.doculect AS a, y.doculect AS b FROM taxa x JOIN taxa y ON x.doculect < y.doculect),
has AS (SELECT DISTINCT doculect, concept FROM wl),
both_have AS (SELECT x.doculect AS a, y.doculect AS b, count(*) AS n FROM has x JOIN has y ON x.concept = y.concept AND x.doculect < y.doculect GROUP BY ALL),
refs AS (SELECT DISTINCT doculect, concept, cogid FROM wl),
share AS (SELECT x.doculect AS a, y.doculect AS b, count(DISTINCT x.concept) AS n
  FROM refs x JOIN refs y ON x.concept = y.concept AND x.cogid = y.cogid AND x.doculect < y.doculect GROUP BY ALL)"""


@query(f"""{_TAXA_SQL} SELECT a, b, round(CASE WHEN coalesce(h.n, 0) = 0 THEN 1.0 ELSE 1 - coalesce(s.n, 0) / h.n END, 9) AS distance
FROM pairs LEFT JOIN both_have h USING (a, b) LEFT JOIN share s USING (a, b)""")
def wl_distance_swadesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.distance_swadesh(wordlist(spark, sf_dir)).withColumn("distance", F.round("distance", 9))


@query(f"""{_TAXA_SQL} SELECT a, b, round(1 - coalesce(s.n, 0) / (SELECT count(DISTINCT concept) FROM wl), 9) AS distance
FROM pairs LEFT JOIN share s USING (a, b)""")
def distance_swadesh_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.distance_swadesh(wordlist(spark, sf_dir), ignore_missing=True).withColumn("distance", F.round("distance", 9))


@query(f"""{_TAXA_SQL}, sets AS (SELECT DISTINCT doculect, cogid FROM wl), sizes AS (SELECT doculect, count(*) AS n FROM sets GROUP BY 1),
counts AS (SELECT doculect, concept, count(*) AS n FROM wl GROUP BY ALL), cells AS (SELECT sum(m) AS n FROM (SELECT concept, max(n) AS m FROM counts GROUP BY 1)),
gap AS (SELECT doculect, (count(*) < (SELECT n FROM cells))::INT AS g FROM wl GROUP BY 1),
common AS (SELECT x.doculect AS a, y.doculect AS b, count(*) AS n FROM sets x JOIN sets y ON x.cogid = y.cogid AND x.doculect < y.doculect GROUP BY ALL)
SELECT p.a, p.b, round(1 - coalesce(c.n, 0) / (sa.n + sb.n - coalesce(c.n, 0) + greatest(ga.g, gb.g)), 9) AS distance
FROM pairs p LEFT JOIN common c USING (a, b) JOIN sizes sa ON sa.doculect = p.a JOIN sizes sb ON sb.doculect = p.b
JOIN gap ga ON ga.doculect = p.a JOIN gap gb ON gb.doculect = p.b""")
def distance_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.distance_jaccard(wordlist(spark, sf_dir)).withColumn("distance", F.round("distance", 9))


@query(f"""{_TAXA_SQL}, sets AS (SELECT DISTINCT doculect, cogid FROM wl)
SELECT q.a, q.b, (SELECT count(*) FROM wl WHERE doculect = q.a AND cogid IN (SELECT cogid FROM sets WHERE doculect = q.b)) AS shared
FROM (SELECT a, b FROM pairs UNION ALL SELECT doculect, doculect FROM taxa) q""")
def distance_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.shared_words(wordlist(spark, sf_dir))


@query(" SELECT doculect, count(DISTINCT concept) AS absolute, round(count(DISTINCT concept) / (SELECT count(DISTINCT concept) FROM wl), 9) AS ratio FROM wl GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.coverage(wordlist(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


@query(" SELECT doculect, concept, count(*) AS words FROM wl GROUP BY ALL")
def synonymy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.synonymy(wordlist(spark, sf_dir))


@query(f"{_TAXA_SQL} SELECT a, b, coalesce(n, 0) AS concepts FROM pairs LEFT JOIN both_have USING (a, b)")
def mutual_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.mutual_coverage(wordlist(spark, sf_dir))


@query(f"{_TAXA_SQL} SELECT round(avg(coalesce(n, 0)) / (SELECT count(DISTINCT concept) FROM wl), 9) AS average_coverage FROM pairs LEFT JOIN both_have USING (a, b)")
def average_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.average_coverage(wordlist(spark, sf_dir)).withColumn("average_coverage", F.round("average_coverage", 9))


@query()
def largest_coverage_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.largest_coverage_group(wordlist(spark, sf_dir), 15)


@query("""  SELECT sets, height, words, round((sets - height) / (words - height), 9) AS diversity
FROM (SELECT count(DISTINCT cogid) AS sets, count(DISTINCT concept) AS height, count(*) AS words FROM wl)""")
def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.diversity(wordlist(spark, sf_dir)).withColumn("diversity", F.round("diversity", 9))


@query(" SELECT cogid, doculect, string_agg(id::VARCHAR, ' ' ORDER BY id) AS ids FROM wl GROUP BY ALL")
def etymdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.etymdict(wordlist(spark, sf_dir))


@query("""  , taxa AS (SELECT DISTINCT doculect FROM wl), sets AS (SELECT cogid, count(DISTINCT concept) AS meanings, min(concept) AS concept FROM wl GROUP BY 1)
SELECT s.cogid, t.doculect, CASE WHEN EXISTS (SELECT 1 FROM wl w WHERE w.cogid = s.cogid AND w.doculect = t.doculect) OR s.meanings > 1 THEN 1
WHEN NOT EXISTS (SELECT 1 FROM wl w WHERE w.concept = s.concept AND w.doculect = t.doculect) THEN -1 ELSE 0 END AS state
FROM sets s CROSS JOIN taxa t""")
def paps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.paps(wordlist(spark, sf_dir), missing=-1)


@query("""  , marked AS (SELECT *, cogid || '/' || concept AS glid FROM wl), taxa AS (SELECT DISTINCT doculect FROM wl),
sets AS (SELECT DISTINCT glid, concept FROM marked)
SELECT s.glid, t.doculect, CASE WHEN EXISTS (SELECT 1 FROM marked w WHERE w.glid = s.glid AND w.doculect = t.doculect) THEN 1
WHEN NOT EXISTS (SELECT 1 FROM wl w WHERE w.concept = s.concept AND w.doculect = t.doculect) THEN -1 ELSE 0 END AS state
FROM sets s CROSS JOIN taxa t""")
def paps_by_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = wordlist(spark, sf_dir).withColumn("glid", F.concat_ws("/", "cogid", "concept"))
    return tb.paps(marked, "glid", missing=-1)


@query("  SELECT id, cogid, dense_rank() OVER (ORDER BY cogid) AS number FROM wl")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.renumber(wordlist(spark, sf_dir), "cogid", "number").select("id", "cogid", "number")


@query("  SELECT id, doculect, concept, row_number() OVER (PARTITION BY concept, doculect ORDER BY id) AS slot FROM wl")
def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.slots(wordlist(spark, sf_dir)).select("id", "doculect", "concept", F.col("slot").cast("long").alias("slot"))


#: The nations of the driver's tables, which are the doculects.
NATIONS = [f"NATION_{k}" for k in range(25)]
_COLUMNS_SQL = ", ".join(f"""min(form) FILTER (WHERE doculect = '{n}') AS "{n}\"""" for n in NATIONS)


@query(f"""  , s AS (SELECT *, row_number() OVER (PARTITION BY concept, doculect ORDER BY id) AS slot FROM wl)
SELECT concept, slot, {_COLUMNS_SQL} FROM s GROUP BY ALL""")
def pivot_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = tb.pivot_entries(wordlist(spark, sf_dir), "form")
    return matrix.select("concept", F.col("slot").cast("long").alias("slot"), *[F.col(f"`{c}`") if c in matrix.columns else F.lit(None).cast("string").alias(c) for c in NATIONS])


@query("""  SELECT concept, row_number() OVER (PARTITION BY concept, doculect ORDER BY id) AS slot, doculect, form FROM wl""")
def pivot_entries_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = tb.pivot_entries(wordlist(spark, sf_dir), "form").withColumn("slot", F.col("slot").cast("long"))
    doculects = [c for c in matrix.columns if c not in ("concept", "slot")]
    return matrix.unpivot(["concept", "slot"], doculects, "doculect", "form").where("form is not null")


@query("""  SELECT id, 'doculect' AS "column", doculect AS value FROM wl UNION ALL SELECT id, 'concept', concept FROM wl
UNION ALL SELECT id, 'form', form FROM wl UNION ALL SELECT id, 'cogid', cogid FROM wl""")
def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.triples(wordlist(spark, sf_dir), ["doculect", "concept", "form", "cogid"])


@query("  SELECT id, doculect, concept, form, cogid FROM wl")
def triples_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doculect", "concept", "form", "cogid"]
    return tb.from_triples(tb.triples(wordlist(spark, sf_dir), columns), columns)


@query("""  , taxa AS (SELECT DISTINCT doculect FROM wl), s AS (SELECT DISTINCT concept, doculect, cogid FROM wl),
gap AS (SELECT concept, (count(DISTINCT doculect) < (SELECT count(*) FROM taxa))::INT AS g FROM s GROUP BY 1),
r AS (SELECT concept, doculect, g + dense_rank() OVER (PARTITION BY concept ORDER BY cogid) AS k FROM s JOIN gap USING (concept)),
c AS (SELECT concept, doculect, count(*) AS n, string_agg(CASE WHEN k <= 62 THEN substr('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', k, 1) ELSE '<' || k || '>' END, '' ORDER BY k) AS t FROM r GROUP BY ALL)
SELECT k.concept, t.doculect, coalesce(CASE WHEN c.n = 1 THEN c.t ELSE '(' || c.t || ')' END, '-') AS states
FROM (SELECT DISTINCT concept FROM wl) k CROSS JOIN taxa t LEFT JOIN c ON c.concept = k.concept AND c.doculect = t.doculect""")
def multistate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.multistate(wordlist(spark, sf_dir))


@query("  SELECT id, (row_number() OVER (PARTITION BY doculect, form ORDER BY id) > 1)::INT AS duplicate FROM wl")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.duplicates(wordlist(spark, sf_dir)).select("id", "duplicate")


@query("""  , o AS (SELECT concept, doculect, form, min(id) AS id FROM wl GROUP BY ALL),
p AS (SELECT x.concept, x.doculect AS a, y.doculect AS b, x.id AS id_a, y.id AS id_b, x.form AS fa, y.form AS fb
  FROM o x JOIN o y ON x.concept = y.concept AND x.doculect < y.doculect)
SELECT a, b, id_a, id_b FROM (SELECT *, row_number() OVER (PARTITION BY a, b, fa, fb ORDER BY id_a, id_b) AS r FROM p) WHERE r = 1""")
def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.word_pairs(wordlist(spark, sf_dir)).select("a", "b", "id_a", "id_b")


@query("  SELECT doculect, cogid, count(DISTINCT form) AS forms FROM wl GROUP BY ALL HAVING count(DISTINCT form) > 1")
def check_strict_cognates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.check_strict_cognates(wordlist(spark, sf_dir))


_CHARS = "string_split(form, '')"


@query("""  , c AS (SELECT doculect, unnest(list_transform(range(1, length(form) + 1), lambda i: form[i:i])) AS segment FROM wl)
SELECT doculect, segment, count(*) AS n FROM c GROUP BY ALL""")
def sound_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = wordlist(spark, sf_dir).select("doculect", F.explode(F.filter(F.split("form", ""), lambda x: x != "")).alias("segment"))
    return words.groupBy("doculect", "segment").agg(F.count("*").alias("n"))


@query("  SELECT doculect, round(avg(length(form)), 9) AS mean_length FROM wl GROUP BY 1")
def word_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordlist(spark, sf_dir).groupBy("doculect").agg(F.round(F.avg(F.length("form")), 9).alias("mean_length"))


_DOC_WORDS = "SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS w FROM documents"


def _doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", F.filter(F.split("text", r"[ \n]+"), lambda x: x != "").alias("words"))


@query(f"""  , d AS ({_DOC_WORDS}), p AS (SELECT list_concat(['$$$'], w, ['$$$']) AS w FROM d),
g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS ngram FROM p) SELECT ngram, count(*) AS n FROM g GROUP BY 1""")
def ngrams_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ng.count_ngrams(_doc_words(spark, sf_dir), F.col("words"), 2)


@query(f"""  , d AS ({_DOC_WORDS}), p AS (SELECT list_concat(['$$$', '$$$'], w, ['$$$', '$$$']) AS w FROM d),
g AS (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS ngram FROM p) SELECT ngram, count(*) AS n FROM g GROUP BY 1""")
def ngrams_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ng.count_ngrams(_doc_words(spark, sf_dir), F.col("words"), 3)


_FORM_WORDS = "SELECT DISTINCT form, string_split(form, ' ') AS w FROM wl"


@query(f"""  , d AS ({_FORM_WORDS}), p AS (SELECT form, list_concat(['$$$'], w, ['$$$']) AS w FROM d)
SELECT form, w[i] || ' ' || w[j] AS skipgram FROM (SELECT form, w, unnest(range(1, len(w) + 1)) AS i FROM p), (SELECT unnest([1, 2, 3]) AS s) k, LATERAL (SELECT i + s AS j) x WHERE j <= len(w)""")
def ngrams_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = wordlist(spark, sf_dir).select("form").distinct()
    return forms.select("form", F.explode(ng.skipngrams(ng.segments(F.col("form")), 2, 2)).alias("g")).select("form", F.array_join("g", " ").alias("skipgram"))


@query(f"""  , d AS ({_FORM_WORDS}), p AS (SELECT w, list_concat(['$$$'], w, ['$$$']) AS q FROM d),
g AS (SELECT q[i] || ' ### ' || q[i+2] AS context, w[i] AS state FROM (SELECT w, q, unnest(range(1, len(w) + 1)) AS i FROM p))
SELECT context, state, count(*) AS n FROM g GROUP BY ALL""")
def ngrams_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = wordlist(spark, sf_dir).select("form").distinct()
    return ng.context_counts(forms, ng.segments(F.col("form")), 1, 1)


_COUNTS_SQL = f"""  , d AS ({_FORM_WORDS}), p AS (SELECT w, list_concat(['$$$'], w) AS q FROM d),
c AS (SELECT q[i] || ' ###' AS context, w[i] AS state, count(*) AS n FROM (SELECT w, q, unnest(range(1, len(w) + 1)) AS i FROM p) GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY context) AS total, count(*) OVER (PARTITION BY context) AS kinds FROM c)"""


def _smoothing(method: str, options: dict, p: str, p0: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        forms = wordlist(spark, sf_dir).select("form").distinct()
        counts = ng.context_counts(forms, ng.segments(F.col("form")), 1, 0)
        return sm.smooth(counts, method, **options).select("context", "state", F.round("logprob", 9).alias("logprob"), F.round("p0", 9).alias("p0"))

    sql = f"{_COUNTS_SQL} SELECT context, state, round(ln({p}), 9) AS logprob, round(ln({p0}), 9) AS p0 FROM t"
    query(sql, f"smooth_{method}")(run)


_smoothing("uniform", {"unseen": 0.1}, "0.9 / kinds", "0.1::DOUBLE")
_smoothing("mle", {"unseen": 0.1}, "n / total * 0.9", "0.1::DOUBLE")
_smoothing("lidstone", {"gamma": 0.2, "bins": 100}, "(n + 0.2) / (total + 20.0)", "0.2 / (total + 20.0)")
_smoothing("laplace", {"bins": 100}, "(n + 1) / (total + 100)", "1 / (total + 100)")
_smoothing("ele", {"bins": 100}, "(n + 0.5) / (total + 50.0)", "0.5 / (total + 50.0)")
_smoothing("wittenbell", {"bins": 100}, "n / (total + kinds)", "kinds / (greatest(100 - kinds, 1) * (total + kinds))")
_smoothing("certaintydegree", {"bins": 100, "unseen": 0.1}, "n / total * least(1 - pow(kinds / 101.0, total), 0.9)", "1 - least(1 - pow(kinds / 101.0, total), 0.9)")


@query()
def smooth_sgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ng.context_counts(_doc_words(spark, sf_dir), F.col("words"), 0, 0)
    return sm.smooth(counts, "sgt").select("context", "state", F.round("logprob", 9).alias("logprob"), F.round("p0", 9).alias("p0"))


@query(f"""  , d AS ({_FORM_WORDS}), c AS (SELECT unnest(w) AS grapheme FROM d) SELECT grapheme, count(*) AS frequency FROM c GROUP BY 1""")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = wordlist(spark, sf_dir).select("form").distinct()
    return forms.select(F.explode(ng.segments(F.col("form"))).alias("grapheme")).groupBy("grapheme").agg(F.count("*").alias("frequency"))


def _with_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wordlist with a second classification to hold against the first: forms that begin alike, within a concept."""
    return wordlist(spark, sf_dir).withColumn("testid", F.concat_ws("/", "concept", F.substring("form", 1, 3))).withColumn("cogid", F.concat_ws("/", "concept", "cogid"))


_TEST_SQL = "  , w AS (SELECT id, doculect, concept, form, concept || '/' || cogid AS cogid, concept || '/' || form[1:3] AS testid FROM wl)"
_FIRSTS_SQL = f"""{_TEST_SQL}, g AS (SELECT cogid AS ref, doculect, min(id) AS id FROM w GROUP BY ALL), t AS (SELECT testid AS ref, doculect, min(id) AS id FROM w GROUP BY ALL)"""


@query(f"""{_FIRSTS_SQL},
gw AS (SELECT g.ref, w.testid AS other FROM g JOIN w USING (id)), tw AS (SELECT t.ref, w.cogid AS other FROM t JOIN w USING (id)),
r AS (SELECT avg(x) AS recall FROM (SELECT count(*) OVER (PARTITION BY ref, other) / count(*) OVER (PARTITION BY ref) AS x FROM gw)),
p AS (SELECT avg(x) AS precision FROM (SELECT count(*) OVER (PARTITION BY ref, other) / count(*) OVER (PARTITION BY ref) AS x FROM tw))
SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round(2 * precision * recall / (precision + recall), 9) AS fscore FROM p, r""")
def bcubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.bcubes(_with_test(spark, sf_dir)).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "fscore")])


@query(f"""{_TEST_SQL}, s AS (SELECT concept, count(*) OVER (PARTITION BY concept, cogid, testid) / count(*) OVER (PARTITION BY concept, cogid) AS r,
  count(*) OVER (PARTITION BY concept, cogid, testid) / count(*) OVER (PARTITION BY concept, testid) AS p FROM w),
m AS (SELECT concept, avg(p) AS precision, avg(r) AS recall FROM s GROUP BY 1)
SELECT concept, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2 * precision * recall / (precision + recall), 9) AS fscore FROM m""")
def bcubes_by_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.bcubes_by_concept(_with_test(spark, sf_dir)).select("concept", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "fscore")])


@query(f"""{_FIRSTS_SQL},
pg AS (SELECT x.id AS i, y.id AS j FROM g x JOIN g y ON x.ref = y.ref AND x.id < y.id), pt AS (SELECT x.id AS i, y.id AS j FROM t x JOIN t y ON x.ref = y.ref AND x.id < y.id),
n AS (SELECT (SELECT count(*) FROM pg JOIN pt USING (i, j)) AS b, (SELECT count(*) FROM pg) AS g, (SELECT count(*) FROM pt) AS t)
SELECT round(b / t, 9) AS precision, round(b / g, 9) AS recall, round(2 * (b / t) * (b / g) / (b / t + b / g), 9) AS fscore FROM n""")
def pairs_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.pair_scores(_with_test(spark, sf_dir)).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "fscore")])


@query(f"""{_TEST_SQL}, p AS (SELECT doculect, id, length(form) AS score, (cogid LIKE '%BRASS')::INT AS rel FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY doculect ORDER BY score, id) AS n, sum(rel) OVER (PARTITION BY doculect ORDER BY score, id) AS f FROM p)
SELECT doculect, round(CASE WHEN sum(rel) = 0 THEN 0.0 ELSE sum(rel * f / n) / sum(rel) END, 9) AS average_precision FROM k GROUP BY 1""")
def npoint_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_test(spark, sf_dir).select("doculect", "id", F.length("form").alias("score"), F.col("cogid").endswith("BRASS").alias("relevant"))
    return ev.average_precision(rows, "score", "relevant", groups=["doculect"]).withColumn("average_precision", F.round("average_precision", 9))


@query("  SELECT id, dense_rank() OVER (ORDER BY concept) AS extremeid FROM wl")
def extreme_cognates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.extreme_cognates(wordlist(spark, sf_dir)).select("id", "extremeid")


@query("""  , f AS (SELECT *, row_number() OVER (PARTITION BY cogid ORDER BY id) AS r FROM wl)
SELECT round(avg(levenshtein(form, cogid)), 9) AS distance, round(avg(levenshtein(form, cogid) / greatest(length(form), length(cogid))), 9) AS normalized FROM f WHERE r = 1""")
def mean_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    words = wordlist(spark, sf_dir).withColumn("gold", chars("form")).withColumn("test", chars("cogid"))
    return ev.mean_edit_distance(words, "gold", "test").select(*[F.round(c, 9).alias(c) for c in ("distance", "normalized")])


_COLEX_SQL = "  , o AS (SELECT DISTINCT doculect, form, concept FROM wl), c AS (SELECT x.doculect, x.form, x.concept AS a, y.concept AS b FROM o x JOIN o y ON x.doculect = y.doculect AND x.form = y.form AND x.concept < y.concept)"


@query(f"{_COLEX_SQL} SELECT a, b, count(*) AS word_weight, count(DISTINCT doculect) AS doculect_weight, count(DISTINCT doculect) AS family_weight FROM c GROUP BY ALL")
def colexification_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.edges(wordlist(spark, sf_dir))


@query(f"{_COLEX_SQL} SELECT form, concept, count(DISTINCT doculect) AS doculects FROM (SELECT doculect, form, a AS concept FROM c UNION SELECT doculect, form, b FROM c) GROUP BY ALL")
def colexification_bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.bipartite_edges(wordlist(spark, sf_dir))


@query(f"""{_COLEX_SQL}, e AS (SELECT a, b, count(*) AS w FROM c GROUP BY ALL)
SELECT concept, count(*) AS degree, sum(w)::BIGINT AS weighted_degree FROM (SELECT a AS concept, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY 1""")
def colexification_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.degrees(wordlist(spark, sf_dir))


@query(f"""{_COLEX_SQL}, s AS (SELECT DISTINCT doculect, a AS c1, b AS c2 FROM c), n AS (SELECT doculect, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT x.doculect AS a, y.doculect AS b, count(*) AS n FROM s x JOIN s y USING (c1, c2) WHERE x.doculect < y.doculect GROUP BY ALL), taxa AS (SELECT DISTINCT doculect FROM wl)
SELECT p.doculect AS a, q.doculect AS b, CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(k.n, 0) > 0 THEN round(1 - coalesce(k.n, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(k.n, 0)), 9) END AS distance
FROM taxa p JOIN taxa q ON p.doculect < q.doculect LEFT JOIN n x ON x.doculect = p.doculect LEFT JOIN n y ON y.doculect = q.doculect LEFT JOIN k ON k.a = p.doculect AND k.b = q.doculect""")
def colexification_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.distances(wordlist(spark, sf_dir)).withColumn("distance", F.round("distance", 9))


@query("  SELECT concept, count(*) AS words, count(DISTINCT doculect) AS doculects, count(DISTINCT doculect) AS families FROM wl GROUP BY 1")
def node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.nodes(wordlist(spark, sf_dir))


@query("""  , k AS (SELECT doculect, concept, form FROM wl), f AS (SELECT DISTINCT concept, form FROM k),
e AS (SELECT x.concept, x.form AS a, y.form AS b FROM f x JOIN f y ON x.concept = y.concept AND x.form <> y.form AND levenshtein(x.form, y.form) / greatest(length(x.form), length(y.form)) <= 0.4),
r AS (WITH RECURSIVE r AS (SELECT concept, form AS a, form AS b FROM f UNION SELECT r.concept, r.a, e.b FROM r JOIN e ON r.concept = e.concept AND r.b = e.a) SELECT concept, a, min(b) AS label FROM r GROUP BY ALL)
SELECT wl.id, wl.concept || ':' || r.label AS clusterid FROM wl JOIN r ON wl.concept = r.concept AND wl.form = r.a""")
def cluster_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cg.single_linkage(wordlist(spark, sf_dir), st.ldn, 0.4).select("id", "clusterid")


#: Pairs of distinct forms of a concept with their distance: by characters, and by words (every form has two).
_CHARACTERS = "levenshtein(x.form, y.form) / greatest(length(x.form), length(y.form))"
_TWO_WORDS = "((split_part(x.form, ' ', 1) <> split_part(y.form, ' ', 1))::INT + (split_part(x.form, ' ', 2) <> split_part(y.form, ' ', 2))::INT) / 2"


def _distances_sql(distance: str) -> str:
    return f"""  , f AS (SELECT DISTINCT concept, form FROM wl),
d AS MATERIALIZED (SELECT x.concept, x.form AS a, y.form AS b, {distance} AS d FROM f x JOIN f y ON x.concept = y.concept AND x.form < y.form)"""


def _linkage_rounds(measure: str, threshold: float, rounds: int = 14) -> str:
    """Common table expressions l1, l2, ...: clusters (c) of the items (form) of l0 after each round of merging all pairs that are each other's nearest."""
    steps = []
    for r in range(rounds):
        steps.append(f"""p{r} AS MATERIALIZED (
  SELECT concept, least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, round({measure}, 9) AS d
  FROM d JOIN l{r} x USING (concept) JOIN l{r} y USING (concept) WHERE x.form = d.a AND y.form = d.b AND x.c <> y.c GROUP BY ALL
),
n{r} AS (SELECT concept, node, min({{'d': d, 'k': md5(a || '|' || b), 'a': a, 'b': b}}) AS p FROM (SELECT concept, unnest([a, b]) AS node, d, a, b FROM p{r} WHERE d <= {threshold}) GROUP BY ALL),
m{r} AS (SELECT concept, p.a, p.b FROM n{r} GROUP BY ALL HAVING count(*) = 2),
l{r + 1} AS MATERIALIZED (SELECT l.concept, form, coalesce(m.a, c) AS c FROM l{r} l LEFT JOIN m{r} m ON l.concept = m.concept AND l.c = m.b)""")
    return ",\n".join(steps)


def _linkage_sql(distance: str, threshold: float, linkage: str) -> str:
    """Average or complete linkage."""
    rounds = _linkage_rounds({"upgma": "avg(d)", "complete": "max(d)"}[linkage], threshold)
    start = f"{_distances_sql(distance)}, l0 AS (SELECT concept, form, form AS c FROM f),\n{rounds}"
    return f"{start} SELECT wl.id, wl.concept || ':' || l.c AS clusterid FROM wl JOIN l14 l ON wl.concept = l.concept AND wl.form = l.form"


def _clustered(method: str, linkage: str, threshold: float, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cg.cluster(wordlist(spark, sf_dir), method, linkage, threshold).select("id", "clusterid")

    query(sql, name=f"cluster_{linkage}_{method.replace('-', '_')}")(run)


_clustered("sca", "upgma", 0.45)
_clustered("edit-dist", "upgma", 0.6, _linkage_sql(_TWO_WORDS, 0.6, "upgma"))
_clustered("edit-dist", "complete", 0.6, _linkage_sql(_TWO_WORDS, 0.6, "complete"))
_clustered("edit-dist", "mcl", 0.6)
_clustered("edit-dist", "infomap", 0.6)
_clustered("turchin", "single", 0.5)


def _linkage_query(linkage: str, threshold: float) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = wordlist(spark, sf_dir)
        return cg.with_clusters(words, lk.flat_clusters(cg.form_pairs(words, st.ldn), threshold, linkage)).select("id", "clusterid")

    query(_linkage_sql(_CHARACTERS, threshold, linkage), name=f"cluster_{linkage}")(run)


_linkage_query("upgma", 0.55)
_linkage_query("complete", 0.65)


@query(f"""{_distances_sql(_CHARACTERS)}, e AS (SELECT concept, a, b FROM d WHERE d <= 0.5 UNION ALL SELECT concept, b, a FROM d WHERE d <= 0.5),
k AS (SELECT concept, a AS c FROM e GROUP BY ALL HAVING count(*) >= 5), ke AS (SELECT e.* FROM e SEMI JOIN k ON e.concept = k.concept AND e.a = k.c SEMI JOIN k q ON e.concept = q.concept AND e.b = q.c),
r AS (WITH RECURSIVE r AS (SELECT concept, c AS a, c AS b FROM k UNION SELECT r.concept, r.a, ke.b FROM r JOIN ke ON r.concept = ke.concept AND r.b = ke.a) SELECT concept, a, min(b) AS root FROM r GROUP BY ALL),
border AS (SELECT e.concept, e.a, min(e.b) AS b FROM e ANTI JOIN k ON e.concept = k.concept AND e.a = k.c SEMI JOIN k q ON e.concept = q.concept AND e.b = q.c GROUP BY ALL),
s AS (SELECT concept, a, root FROM r UNION ALL SELECT concept, border.a, root FROM border JOIN r USING (concept) WHERE border.b = r.a)
SELECT wl.id, wl.concept || ':' || coalesce(s.root, wl.form) AS clusterid FROM wl LEFT JOIN s ON wl.concept = s.concept AND wl.form = s.a""")
def cluster_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = wordlist(spark, sf_dir)
    return cg.with_clusters(words, lk.density_clusters(cg.form_pairs(words, st.ldn), 0.5, least=6)).select("id", "clusterid")


def _fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words by finer concepts, brand and size: all words of a concept are compared with each other. They are read many times, the lines once."""
    return kept(wordlist(spark, sf_dir, F.concat_ws("/", "p_brand", "p_size")))


@query()
def lexstat_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.scorer(_fine(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query()
def lexstat_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _fine(spark, sf_dir)
    real = kept(ls.attested_pairs(words))
    return ls.distances(real.where("a < b"), kept(ls.scorer(words, real=real))).withColumn("distance", F.round("distance", 9))


@query()
def cluster_lexstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _fine(spark, sf_dir)
    return ls.cluster(words, kept(ls.scorer(words))).select("id", "lexstatid")


#: Symbols of doculects that meet in words for one concept, on the alignment place by place (no gaps inside).
@query("""  , w AS (SELECT DISTINCT concept, doculect, form FROM wl),
p AS (SELECT DISTINCT x.doculect AS a, y.doculect AS b, x.form AS p, y.form AS q FROM w x JOIN w y ON x.concept = y.concept AND x.doculect < y.doculect
  UNION SELECT doculect, doculect, form, form FROM w),
c AS (SELECT a, b, unnest(range(1, least(length(p), length(q)) + 1)) AS k, p, q FROM p)
SELECT a, b, p[k:k] AS x, q[k:k] AS y, count(*)::DOUBLE AS n FROM c GROUP BY ALL""")
def lexstat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = ls.attested_pairs(wordlist(spark, sf_dir))
    cut = lambda c: F.filter(F.split(F.substring(c, F.lit(1), F.least(F.length("entry_a"), F.length("entry_b"))), ""), lambda x: x != "")
    met = real.select("entry_a", "entry_b").distinct().withColumns({"mode": F.lit(0), "distance": F.lit(0.0), "x": cut("entry_a"), "y": cut("entry_b")})
    return ls.symbol_counts(real, met, None, 1)[0]


@query()
def doculect_distances_sca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cg.doculect_distances(wordlist(spark, sf_dir)).withColumn("distance", F.round("distance", 9))


@query()
def correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cg.correspondences(wordlist(spark, sf_dir))


@query()
def log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    attested = cg.correspondences(wordlist(spark, sf_dir))
    return cg.log_odds(attested, cg.expected_correspondences(attested)).withColumn("score", F.round("score", 9))


@query("""  SELECT id, concept, string_split(form, ' ')[1] AS first, len(string_split(form, ' ')) AS parts FROM wl""")
def partial_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = wordlist(spark, sf_dir)
    parts = cg.partial_slices(words.withColumn("segments", F.split(F.replace("form", F.lit(" "), F.lit(" + ")), " ")))
    first = F.min(F.when(F.col("part") == 0, F.array_join("morpheme", " "))).alias("first")
    return parts.groupBy("id", "concept").agg(first, F.count("*").alias("parts"))


@query("""  SELECT id, concept, unnest(range(0, len(p))) AS part, unnest(p) AS morpheme FROM (SELECT id, concept, string_split(form, ' ') AS p FROM wl)""")
def partial_slices_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = wordlist(spark, sf_dir)
    parts = cg.partial_slices(words.withColumn("segments", F.split(F.replace("form", F.lit(" "), F.lit(" + ")), " ")))
    return parts.select("id", "concept", F.col("part").cast("long").alias("part"), F.array_join("morpheme", " ").alias("morpheme"))


_PARTS_SQL = """  , f AS (SELECT row_number() OVER (ORDER BY doculect, concept, form, cogid) AS id, concept, form FROM (
  SELECT DISTINCT n_name AS doculect, p_brand || '/' || p_size || '/' || p_type AS concept, p_name AS form, p_type AS cogid
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)),
m AS MATERIALIZED (SELECT concept, id, k - 1 AS part, printf('%019d/%04d', id, k - 1) AS node, split_part(form, ' ', k) AS w FROM (SELECT *, unnest([1, 2]) AS k FROM f)),
d AS MATERIALIZED (SELECT x.concept, x.node AS a, y.node AS b, CASE WHEN x.id <> y.id THEN levenshtein(x.w, y.w) / greatest(length(x.w), length(y.w)) END AS d FROM m x JOIN m y ON x.concept = y.concept AND x.node < y.node),
l0 AS (SELECT concept, node AS form, node AS c FROM m)"""


@query(f"""{_PARTS_SQL},
{_linkage_rounds("CASE WHEN count(d) = count(*) THEN avg(d) END", 0.5)},
r AS (SELECT m.id, m.part, m.concept || ':' || regexp_replace(l.c, '^0*([0-9]+)/0*([0-9]+)$', '\\1/\\2') AS label FROM m JOIN l14 l ON m.concept = l.concept AND m.node = l.form)
SELECT id, string_agg(label, ' ' ORDER BY part) AS partialids FROM r GROUP BY 1""")
def partial_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = kept(wordlist(spark, sf_dir, F.concat_ws("/", "p_brand", "p_size", "p_type")))
    segments = F.split(F.replace(F.array_join(F.split("form", ""), "|"), F.lit("| |"), F.lit("|+|")), r"\|")
    found = cg.partial_clusters(words.withColumn("segments", F.filter(segments, lambda x: x != "")), st.ldn, 0.5)
    return found.select("id", F.array_join("partialids", " ").alias("partialids"))


#: All forms of the tables have two words, and unlike words in one column cost less than gaps: their alignment leaves words in place.
_CELLS_SQL = "  , f AS (SELECT *, string_split(form, ' ') AS w FROM wl), c AS (SELECT cogid, id, doculect, unnest([0, 1]) AS k, unnest(w) AS x FROM f)"


@query("  SELECT id, form AS alignment FROM wl")
def msa_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return am.align_sets(wordlist(spark, sf_dir)).select("id", F.array_join("alignment", " ").alias("alignment"))


def _fine_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words by sets within concepts: a library grows with the cube of a set's forms."""
    return wordlist(spark, sf_dir).withColumn("cogid", F.concat_ws("/", "concept", "cogid"))


@query("  SELECT id, form AS alignment FROM wl")
def msa_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return am.align_sets(_fine_sets(spark, sf_dir), method="library").select("id", F.array_join("alignment", " ").alias("alignment"))


@query("""  , u AS (SELECT DISTINCT concept || '/' || cogid AS block, form, string_split(form, ' ') AS w FROM wl),
p AS MATERIALIZED (SELECT block, a, b, k, same / 2 + (v[k + 1] = w[k + 1])::INT AS weight FROM
  (SELECT x.block, x.form AS a, y.form AS b, x.w AS v, y.w AS w, (x.w[1] = y.w[1])::INT + (x.w[2] = y.w[2])::INT AS same, unnest([0, 1]) AS k FROM u x JOIN u y ON x.block = y.block AND x.form < y.form)),
t AS MATERIALIZED (SELECT * FROM p UNION ALL SELECT block, b, a, k, weight FROM p),
e AS (SELECT * FROM p UNION ALL SELECT x.block, x.a, y.b, x.k, least(x.weight, y.weight) FROM t x JOIN t y ON x.block = y.block AND x.b = y.a AND x.k = y.k WHERE x.a < y.b)
SELECT block, a, k AS i, b, k AS j, round(sum(weight), 9) AS weight FROM e GROUP BY ALL""")
def msa_library_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = am.set_items(_fine_sets(spark, sf_dir)).select("block", "item").distinct()
    return mu.library_weights(units).withColumn("weight", F.round("weight", 9))


@query(f"""{_CELLS_SQL}, n AS (SELECT cogid, k, x, count(*) AS n, min(id) AS first FROM c GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY cogid, k ORDER BY n DESC, first) AS r FROM n)
SELECT cogid, string_agg(x, ' ' ORDER BY k) AS consensus FROM b WHERE r = 1 GROUP BY 1""")
def msa_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return am.consensus(am.align_sets(wordlist(spark, sf_dir)))


@query("""  , u AS (SELECT DISTINCT cogid, form, string_split(form, ' ') AS w FROM wl),
p AS (SELECT x.cogid, avg((x.w[1] = y.w[1])::INT + (x.w[2] = y.w[2])::INT) / 2 AS identity FROM u x JOIN u y ON x.cogid = y.cogid AND x.form < y.form GROUP BY 1)
SELECT cogid, round(coalesce(identity, 1), 9) AS identity FROM (SELECT DISTINCT cogid FROM u) LEFT JOIN p USING (cogid)""")
def msa_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return am.identity_of_sets(am.align_sets(wordlist(spark, sf_dir))).withColumn("identity", F.round("identity", 9))


@query(f"""{_CELLS_SQL}, n AS (SELECT cogid, k, doculect, x, count(*) AS n FROM c GROUP BY ALL)
SELECT p.doculect AS a, q.doculect AS b, p.x, q.x AS y, sum(p.n * q.n)::BIGINT AS n FROM n p JOIN n q ON p.cogid = q.cogid AND p.k = q.k AND p.doculect < q.doculect GROUP BY ALL""")
def msa_correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return am.correspondence_counts(am.align_sets(wordlist(spark, sf_dir)))


def _justified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two alignments of the words of each set: gaps after the word, and before it."""
    words = wordlist(spark, sf_dir)
    wide = words.join(words.groupBy("cogid").agg(F.max(F.length("form")).alias("width")), "cogid")
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return tuple(wide.select("id", "cogid", chars(pad("form", F.col("width"), F.lit("-"))).alias("alignment")) for pad in (F.rpad, F.lpad))


_JUSTIFIED_SQL = "  , w AS (SELECT *, (max(length(form)) OVER (PARTITION BY cogid))::INT AS width FROM wl)"


@query(f"""{_JUSTIFIED_SQL}, c AS (SELECT cogid, id, k, rpad(form, width, '-')[k:k] AS g, lpad(form, width, '-')[k:k] AS t FROM (SELECT *, unnest(range(1, width + 1)) AS k FROM w)),
gc AS (SELECT cogid, k, string_agg(g, '' ORDER BY id) AS s FROM c GROUP BY ALL), tc AS (SELECT cogid, k, string_agg(t, '' ORDER BY id) AS s FROM c GROUP BY ALL),
n AS (SELECT cogid, count(*) FILTER (WHERE s IN (SELECT s FROM tc WHERE tc.cogid = gc.cogid)) AS c, count(*) AS n FROM gc GROUP BY 1),
p AS (SELECT cogid, c / n AS p FROM n)
SELECT cogid, round(p, 9) AS precision, round(p, 9) AS recall, round(p, 9) AS mean, round(p, 9) AS fscore FROM p""")
def msa_column_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return am.column_scores(*_justified(spark, sf_dir)).select("cogid", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "mean", "fscore")])


@query(f"""{_JUSTIFIED_SQL} SELECT cogid, round(avg((length(form) = width)::INT), 9) AS rows FROM w GROUP BY 1""")
def msa_row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return am.row_scores(*_justified(spark, sf_dir)).withColumn("rows", F.round("rows", 9))


@query(f"""{_JUSTIFIED_SQL}, f AS (SELECT cogid, form, width, min(id) AS id, 1 / count(*) AS w FROM w GROUP BY ALL),
c AS (SELECT *, k AS g, width - length(form) + k AS t FROM (SELECT *, unnest(range(1, length(form) + 1)) AS k FROM f)),
p AS (SELECT x.cogid, x.w * y.w AS v, x.g = y.g AS g, x.t = y.t AS t FROM c x JOIN c y ON x.cogid = y.cogid AND x.id < y.id),
s AS (SELECT cogid, sum(v) FILTER (WHERE g) AS r, sum(v) FILTER (WHERE t) AS t, coalesce(sum(v) FILTER (WHERE g AND t), 0) AS c FROM p GROUP BY 1)
SELECT cogid, round(c / r, 9) AS sp_recall, round(c / t, 9) AS sp_precision, round(2 * c / (r + t), 9) AS sp_mean, round(c / (r + t - c), 9) AS jaccard FROM s""")
def msa_residue_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return am.residue_scores(*_justified(spark, sf_dir)).select("cogid", *[F.round(c, 9).alias(c) for c in ("sp_recall", "sp_precision", "sp_mean", "jaccard")])


@query(f"""{_PAIRS_SQL}, l AS (SELECT la, lb, greatest(la, lb) AS n FROM g),
c AS (SELECT la, lb, n, list_transform(range(1, n + 1), lambda i: [CASE WHEN i <= la THEN i ELSE 0 END, CASE WHEN i <= lb THEN i ELSE 0 END]) AS g,
  list_transform(range(1, n + 1), lambda i: [greatest(i - n + la, 0), greatest(i - n + lb, 0)]) AS t FROM l),
k AS (SELECT (la = n)::INT AS ra, (lb = n)::INT AS rb, n, len(list_filter(t, lambda p: list_contains(g, p))) AS gc, least(la, lb) AS m,
  len(list_filter(t, lambda p: list_contains(g, p) AND p[1] <> 0 AND p[2] <> 0)) AS c FROM c),
s AS (SELECT avg((ra + rb) / 2) AS half_rows, avg(ra * rb) AS rows, sum(gc) / sum(n) AS p, sum(c) / sum(m) AS sp, sum(c) / (2 * sum(m) - sum(c)) AS jaccard FROM k)
SELECT round(half_rows, 9) AS half_rows, round(rows, 9) AS rows, round(p, 9) AS precision, round(p, 9) AS recall, round(p, 9) AS fscore, round(sp, 9) AS sp, round(jaccard, 9) AS jaccard FROM s""")
def psa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _form_pairs(spark, sf_dir).withColumn("n", F.greatest(F.size("a"), F.size("b")))
    gaps = lambda s: F.array_repeat(F.lit("-"), F.col("n") - F.size(s))
    gold = pairs.select("form_a", "form_b", *[F.concat(F.col(s), gaps(s)).alias(s) for s in "ab"])
    test = pairs.select("form_a", "form_b", *[F.concat(gaps(s), F.col(s)).alias(s) for s in "ab"])
    names = ("half_rows", "rows", "precision", "recall", "fscore", "sp", "jaccard")
    return am.pairwise_scores(gold, test, ["form_a", "form_b"]).select(*[F.round(c, 9).alias(c) for c in names])


@query("""  SELECT DISTINCT form, length(regexp_replace(form, '[^aeiouy]', '', 'g')) AS vowels FROM wl""")
def sound_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = wordlist(spark, sf_dir).select("form").distinct()
    kinds = so.class_column(F.filter(F.split("form", ""), lambda c: c != ""))
    return forms.select("form", F.size(F.filter(kinds, lambda c: c == "V")).cast("long").alias("vowels"))


def _gain_loss(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    words = wordlist(spark, sf_dir).withColumn("glid", F.concat_ws("/", "cogid", "concept"))
    tree = ph.doculect_tree(words)
    return ph.scenarios(tb.paps(words, "glid", missing=-1), tree, "glid"), ph.tree_edges(tree)


@query()
def gain_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gain_loss(spark, sf_dir)[0].drop("present")


@query()
def origins_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ph.origin_stats(_gain_loss(spark, sf_dir)[0])
    return stats.withColumn("mean", F.round("mean", 9)).withColumn("patchy", F.round("patchy", 9))


@query()
def vocabulary_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.vocabulary_sizes(_gain_loss(spark, sf_dir)[0])


@query()
def inherited_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.inherited_sizes(*_gain_loss(spark, sf_dir))


@query()
def lateral_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.lateral_edges(*_gain_loss(spark, sf_dir))


def _region_scenarios(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Scenarios of sets by fine concepts on the tree of nations, regions and a root; every gain costs as much as two losses."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    # the dimension of the doculects
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect()
    tree = [(r["n_name"], r["r_name"]) for r in rows] + [(r, "root") for r in {r["r_name"] for r in rows}]
    words = _fine(spark, sf_dir).withColumn("glid", F.concat_ws("/", "cogid", "concept"))
    return ph.scenarios(tb.paps(words, "glid", missing=-1), tree, "glid", gain=2.0), tree


#: Costs and states of nations, regions and the root, one level after the other.
_REGION_SQL = """  , f AS (SELECT DISTINCT n_name AS doculect, p_brand || '/' || p_size AS concept, p_type AS cogid
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
s AS (SELECT DISTINCT cogid, concept, cogid || '/' || concept AS glid FROM f), has AS (SELECT DISTINCT doculect, concept FROM f),
t AS (SELECT n_name AS node, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT s.glid, t.node, t.parent, CASE WHEN f.cogid IS NOT NULL THEN 1 WHEN has.doculect IS NOT NULL THEN 0 END AS s
  FROM s CROSS JOIN t LEFT JOIN f ON f.doculect = t.node AND f.concept = s.concept AND f.cogid = s.cogid LEFT JOIN has ON has.doculect = t.node AND has.concept = s.concept),
c1 AS (SELECT glid, node, parent, CASE WHEN s = 1 THEN 'inf'::DOUBLE ELSE 0 END AS a, CASE WHEN s = 0 THEN 'inf'::DOUBLE ELSE 0 END AS p FROM x),
c2 AS (SELECT glid, parent AS node, sum(least(a, p + 2)) AS a, sum(least(p, a + 1)) AS p FROM c1 GROUP BY ALL),
c3 AS (SELECT glid, sum(least(a, p + 2)) AS a, sum(least(p, a + 1)) AS p FROM c2 GROUP BY ALL),
x3 AS (SELECT glid, (a > p + 2)::INT AS s FROM c3),
x2 AS (SELECT glid, node, x3.s AS above, (a + x3.s > p + 2 * (1 - x3.s))::INT AS s FROM c2 JOIN x3 USING (glid)),
x1 AS (SELECT c1.glid, c1.node, x2.s AS above, (a + x2.s > p + 2 * (1 - x2.s))::INT AS s FROM c1 JOIN x2 ON c1.glid = x2.glid AND c1.parent = x2.node),
n AS (SELECT glid, 'root' AS node, 0 AS above, s FROM x3 UNION ALL SELECT glid, node, above, s FROM x2 UNION ALL SELECT glid, node, above, s FROM x1)"""


@query(f"""{_REGION_SQL} SELECT glid, coalesce(string_agg(node || ':' || s, ',' ORDER BY node) FILTER (WHERE s <> above), '') AS scenario, count(*) FILTER (WHERE s > above) AS origins FROM n GROUP BY 1""")
def gain_loss_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _region_scenarios(spark, sf_dir)[0].select("glid", "scenario", F.col("origins").cast("long").alias("origins"))


@query(f"""{_REGION_SQL} SELECT node, count(*) AS sets FROM n WHERE s = 1 GROUP BY 1""")
def vocabulary_sizes_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.vocabulary_sizes(_region_scenarios(spark, sf_dir)[0])


@query(f"""{_REGION_SQL} SELECT node, count(*) AS sets FROM n WHERE s = 1 AND above = 1 GROUP BY 1""")
def inherited_sizes_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.inherited_sizes(*_region_scenarios(spark, sf_dir))


@query()
def lateral_network_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.lateral_edges(*_region_scenarios(spark, sf_dir))


@query()
def doculect_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = wordlist(spark, sf_dir)
    return spark.createDataFrame([(m, ph.doculect_tree(words, m)) for m in ("upgma", "neighbor")], "method string, newick string")


@query()
def nexus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = wordlist(spark, sf_dir).withColumn("glid", F.concat_ws("/", "cogid", "concept"))
    return wr.state_rows(tb.paps(words, "glid", missing=-1), "glid")


@query("""  , d AS (SELECT DISTINCT form FROM wl), p AS (SELECT list_concat(['#'], list_transform(range(1, length(form) + 1), lambda i: form[i:i]), ['$']) AS w FROM d)
SELECT w[i] AS prev, w[i + 1] AS next, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM p) GROUP BY ALL""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = wordlist(spark, sf_dir).select("form").distinct()
    return ge.transitions(forms.withColumn("s", F.filter(F.split("form", ""), lambda x: x != "")), "s")


@query()
def random_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = wordlist(spark, sf_dir).select("form").distinct()
    return ge.random_words(forms.withColumn("s", F.filter(F.split("form", ""), lambda x: x != "")), "s", 50, 7)

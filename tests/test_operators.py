"""Every query with SQL against DuckDB on the smallest tables, and operators on cases by hand."""

import os
from collections import Counter
from functools import lru_cache
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glossarium import queries as core
from glossarium.functions import ngrams as ng
from glossarium.functions import smoothing as sm
from glossarium.functions import strings as st
from glossarium.operators import alignments as am
from glossarium.operators import cognates as cg
from glossarium.operators import evaluation as ev
from glossarium.operators import table as tb
from glossarium.sources import formats, writers
from glossarium.streaming import counts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def canonical(rows):
    return sorted(tuple(str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_against_sql(spark, duck, name):
    found = entry.queries()[name](spark, DATA)
    result = duck.execute(core.ORACLES[name])
    columns = sorted(d[0] for d in result.description)
    assert sorted(found.columns) == columns
    at = {d[0]: i for i, d in enumerate(result.description)}
    expected = [[r[at[c]] for c in columns] for r in result.fetchall()]
    assert canonical(found.select(*[f"`{c}`" for c in columns]).collect()) == canonical(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


WORDS = [(1, "A", "hand", "abc", "1"), (2, "A", "arm", "abc", "2"), (3, "B", "hand", "abd", "1"), (4, "B", "arm", "xyz", "3"), (5, "C", "hand", "abcd", "1"), (6, "C", "hand", "zz", "4")]


@pytest.fixture(scope="session")
def words(spark):
    return spark.createDataFrame(WORDS, "id long, doculect string, concept string, form string, cogid string")


def test_swadesh_by_hand(words):
    d = {(r.a, r.b): r.distance for r in tb.distance_swadesh(words).collect()}
    assert d == {("A", "B"): 0.5, ("A", "C"): 0.0, ("B", "C"): 0.0}


def test_no_common_concept(spark):
    rows = spark.createDataFrame([(1, "A", "x", "a", "1"), (2, "B", "y", "b", "2")], "id long, doculect string, concept string, form string, cogid string")
    assert tb.distance_swadesh(rows).first().distance == 1.0


def test_renumber_keeps_a_place_for_empty(spark):
    rows = spark.createDataFrame([("b",), ("",), ("a",), ("b",)], "v string")
    assert sorted((r.v, r.n) for r in tb.renumber(rows, "v", "n").collect()) == [("", 0), ("a", 2), ("b", 3), ("b", 3)]


def test_group_of_coverage(words):
    assert sorted(r.doculect for r in tb.largest_coverage_group(words, 2).collect()) == ["A", "B"]


def edit(a, b, swap):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if swap and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@lru_cache(None)
def subsequence(a, b):
    if not a or not b:
        return 0
    return subsequence(a[:-1], b[:-1]) + 1 if a[-1] == b[-1] else max(subsequence(a[:-1], b), subsequence(a, b[:-1]))


def test_metrics(spark):
    pairs = [("levenshtein", "lveenshtiene"), ("abc", "acb"), ("", "ab"), ("a", "a"), ("abab", "baba")]
    df = spark.createDataFrame(pairs, "x string, y string").select("x", "y", cg.segments_of("x").alias("a"), cg.segments_of("y").alias("b"))
    a, b = F.col("a"), F.col("b")
    rows = df.select("x", "y", st.ldn(a, b, False).alias("l"), st.ldn_swap(a, b, False).alias("s"), st.longest_common_subsequence(a, b).alias("c"), st.needleman_wunsch(a, b).alias("n"), st.ident(a, b).alias("i")).collect()
    for r in rows:
        assert r.l == edit(r.x, r.y, False) and r.s == edit(r.x, r.y, True) and r.c == subsequence(r.x, r.y)
        assert r.i == int(r.x == r.y)
    assert rows[0].l == 5 and rows[0].s == 3


def all_grams(s, at=None):
    padded = ["-", "-", *s, "-", "-"]
    return Counter(",".join(padded[i if at is None else at :][:k]) for i in range(len(padded) - 1) for k in (1, 2, 3))


def test_jcdn(spark):
    pairs = [("abc", "abd"), ("abc", "abcd"), ("a", "aaaa"), ("abab", "ab"), ("", "a")]
    df = spark.createDataFrame(pairs, "x string, y string").withColumn("a", cg.segments_of("x")).withColumn("b", cg.segments_of("y"))
    for r in df.select("x", "y", st.jcdn(F.col("a"), F.col("b")).alias("d"), st.jcdn(F.col("a"), F.col("b"), False).alias("n")).collect():
        common = (all_grams(r.x) & all_grams(r.y, len(r.x) + 2)).total()
        total = len(r.x) + len(r.y) - 2 - common
        assert r.d == (1 - common / total if total else 0) and r.n == (total - common if total else 0)


def test_gram_versions(spark):
    one = spark.createDataFrame([(list("ab"), list("ba"))], "a array<string>, b array<string>")
    value = lambda name: one.select(st.METRICS[name](F.col("a"), F.col("b"))).first()[0]
    # -a ab (b-) against -b ba (a-): by places -a and -b differ by a half, ab and ba by one
    assert value("bidist1") == 1.0 and value("bidist2") == 0.25 and value("bidist3") == 0.75
    assert value("bisim1") == 1.0 and value("bisim2") == 0.25 and value("bisim3") == 0.75


def test_percent_identity(spark):
    df = spark.createDataFrame([(list("ab-c"), list("abd-"))], "a array<string>, b array<string>")
    values = df.select(*[st.percent_identity(F.col("a"), F.col("b"), m).alias(str(m)) for m in range(1, 6)]).first()
    assert list(values) == [1.0, 0.5, 2 / 3, 2 / 3, 0.5]


def test_ngrams(spark):
    one = spark.createDataFrame([(list("abc"),)], "s array<string>")
    get = lambda c: ["".join(g) for g in one.select(c.alias("g")).first().g]
    assert get(ng.bigrams(F.col("s"))) == ["$$$a", "ab", "bc", "c$$$"]
    assert get(ng.ngrams(F.col("s"), 2, None)) == ["ab", "bc"]
    assert get(ng.ngrams(F.col("s"), 4, None)) == [] and get(ng.ngrams(F.col("s"), 0)) == []
    assert sorted(get(ng.skipngrams(F.col("s"), 2, 1, None))) == ["ab", "ac", "bc"]
    with pytest.raises(ValueError):
        ng.skipngrams(F.col("s"), 1, 1)
    first = one.select(ng.posngrams(F.col("s"), 1, 1).alias("g")).first().g[0]
    assert (first.context, first.state, first["index"]) == (["$$$", "###", "b"], "a", 0)


def test_smoothing_sums_to_one(spark):
    rows = [("x", c, n) for c, n in zip("abcdefgh", [8, 5, 3, 2, 2, 1, 1, 1])] + [("y", "a", 1)]
    counts_ = spark.createDataFrame(rows, "context string, state string, n long")
    for method, options, seen in (("mle", {}, 1.0), ("uniform", {"unseen": 0.2}, 0.8), ("laplace", {"bins": 8}, 1.0)):
        total = sm.smooth(counts_, method, **options).where("context = 'x'").agg(F.sum(F.exp("logprob"))).first()[0]
        assert abs(total - seen) < 1e-9
    sgt = sm.smooth(counts_, "sgt").where("context = 'x'").agg(F.sum(F.exp("logprob")), F.max(F.exp("p0"))).first()
    assert abs(sum(sgt) - 1) < 1e-9 and abs(sgt[1] - 3 / 23) < 1e-9


def test_perfect_evaluation(words):
    same = words.withColumn("testid", F.col("cogid"))
    assert list(ev.bcubes(same).first()) == [1.0, 1.0, 1.0]
    assert list(ev.pair_scores(same).first()) == [1.0, 1.0, 1.0]
    assert ev.cluster_report(same).count() == 0
    assert ev.random_cognates(words, 1).count() == 6


def test_partial(spark):
    rows = spark.createDataFrame([(1, "A", "x", [1, 2], ["a", "+", "b"]), (2, "B", "x", [2, 3], ["b", "+", "c"]), (3, "C", "x", [4], ["d"])], "id long, doculect string, concept string, ids array<long>, segments array<string>")
    loose = {r.id: r.t for r in cg.loose_ids(rows, "ids", "t").collect()}
    assert loose[1] == loose[2] != loose[3]
    assert len({r.t for r in cg.strict_ids(rows, "ids", "t").collect()}) == 3
    assert [(r.id, r.part, r.morpheme) for r in cg.partial_slices(rows).orderBy("id", "part").collect()][:2] == [(1, 0, ["a"]), (1, 1, ["b"])]
    assert ev.partial_bcubes(rows.withColumn("t", F.col("ids")), "ids", "t").first().fscore == 1.0


def test_alignment_of_sets(words):
    aligned = am.align_sets(words)
    rows = {r.id: r.alignment for r in aligned.collect()}
    assert len(rows) == 6 and len({len(rows[i]) for i in (1, 3, 5)}) == 1
    assert all("".join(x for x in rows[w[0]] if x != "-") == w[3] for w in WORDS)
    same = am.compare_alignments(aligned, aligned).first()
    assert (same.recall, same.precision, same.rows) == (1.0, 1.0, 1.0)
    assert am.consensus(aligned).where("cogid = '3'").first().consensus == "x y z"


def test_residue_scores_count_pairs(spark):
    gold = {1: "ab-c", 2: "a-bc", 3: "abbc", 4: "abbc", 5: "-bc-"}
    test = {1: "abc-", 2: "abc-", 3: "abbc", 4: "abbc", 5: "bc--"}
    frame = lambda x: spark.createDataFrame([(k, "s", list(v)) for k, v in x.items()], "id long, cogid string, alignment array<string>")
    times = Counter(v.replace("-", "") for v in gold.values())
    firsts = {v.replace("-", ""): k for k, v in reversed(gold.items())}

    def met(rows):
        places = {w: {p: sum(c != "-" for c in rows[k][:p]) for p, c in enumerate(rows[k]) if c != "-"} for w, k in firsts.items()}
        return {(x, y, places[x][p], places[y][p]) for x, y in combinations(sorted(firsts), 2) for p in places[x].keys() & places[y].keys()}

    weigh = lambda pairs: sum(1 / times[x] / times[y] for x, y, _, _ in pairs)
    g, t = met(gold), met(test)
    row = am.residue_scores(frame(gold), frame(test)).first()
    assert row.sp_recall == pytest.approx(weigh(g & t) / weigh(g)) and row.sp_precision == pytest.approx(weigh(g & t) / weigh(t))
    assert row.jaccard == pytest.approx(weigh(g & t) / weigh(g | t))
    assert list(am.residue_scores(frame(gold), frame(gold)).first())[1:] == [1.0] * 4
    assert list(am.column_scores(frame(gold), frame(gold)).first())[1:] == [1.0] * 4
    assert am.row_scores(frame(gold), frame(test)).first().rows == 0.4
    assert am.column_scores(frame(gold).limit(0), frame(test).limit(0)).count() == 0


def test_pairwise_scores(spark):
    frame = lambda *x: spark.createDataFrame([(k, list(a), list(b)) for k, (a, b) in enumerate(x)], "k long, a array<string>, b array<string>")
    gold, test = frame(("ab-", "abc"), ("xy", "xy")), frame(("a-b", "abc"), ("xy", "xy"))
    row = am.pairwise_scores(gold, test, ["k"]).first()
    assert (row.half_rows, row.rows, row.precision, row.recall, row.sp) == (0.75, 0.5, 0.6, 0.6, 0.75)
    assert row.jaccard == 3 / 5 and [r.k for r in am.pairwise_differences(gold, test, ["k"]).collect()] == [0]


def test_random_shares(spark):
    counts_ = spark.createDataFrame([("x", "a", 5), ("x", "b", 1), ("y", "a", 2)], "context string, state string, n long")
    again = [sorted(map(tuple, sm.smooth(counts_, "random", seed=s, unseen=0.1).collect())) for s in (1, 1, 2)]
    assert again[0] == again[1] != again[2]
    shares = sm.smooth(counts_, "random", seed=1, unseen=0.1).groupBy("context").agg(F.sum(F.exp("logprob")).alias("s")).collect()
    assert all(abs(r.s - 0.9) < 1e-9 for r in shares)


def test_scorer(words):
    attested = cg.correspondences(words, threshold=1.0)
    assert attested.where("x = 'a' and y = 'a'").count() == 3
    scores = cg.log_odds(attested, cg.expected_correspondences(attested))
    assert scores.where("score is null").count() == 0
    assert am.confidence(am.align_sets(words), scores).count() > 0


def test_readers(spark, tmp_path):
    table = tmp_path / "w.tsv"
    table.write_text("# note\n@tree:(A,B);\nID\tLanguage\tGloss\tIPA\tCogID\n1\tA\thand\tabc\t1\n2\tB\thand\tabd\tx\n", encoding="utf-8")
    rows = formats.read_wordlist(spark, str(table)).orderBy("id").collect()
    assert [(r.id, r.doculect, r.concept, r.form, r.cogid, r.cogid_text) for r in rows] == [(1, "A", "hand", "abc", 1, None), (2, "B", "hand", "abd", None, "x")]
    assert formats.read_metadata(spark, str(table)).first().key == "tree"
    (tmp_path / "bad.tsv").write_text("ID\tLanguage\n1\n", encoding="utf-8")
    with pytest.raises(ValueError):
        formats.read_wordlist(spark, str(tmp_path / "bad.tsv"))
    (tmp_path / "x.msa").write_text("set\nseq\nA...\ta\t-\nBB..\ta\tb\n", encoding="utf-8")
    assert [(r.taxon, r.alignment) for r in formats.read_alignments(spark, str(tmp_path / "x.msa")).orderBy("row").collect()] == [("A", ["a", "-"]), ("BB", ["a", "b"])]
    (tmp_path / "s.tsv").write_text("Number\tWord\tA\tA #\tB\tB #\n1\thand\tabc {ABC}\t1\txyz\t-1\n", encoding="utf-8")
    long = {r.doculect: r for r in formats.read_starling(spark, str(tmp_path / "s.tsv")).collect()}
    assert long["A"].form == "abc" and long["A"].orthography == "ABC" and long["A"].cogid != long["B"].cogid


def test_writers(spark, words, tmp_path):
    distances = tb.distance_swadesh(words)
    (tmp_path / "d.dst").write_text(writers.phylip(distances), encoding="utf-8")
    back = {(r.a, r.b): r.distance for r in formats.read_distances(spark, str(tmp_path / "d.dst")).collect()}
    assert back["A", "B"] == back["B", "A"] == 0.5
    text = writers.nexus(writers.state_rows(tb.paps(words, missing=-1)))
    assert "NTAX=3 NCHAR=4" in text
    writers.write_wordlist(words, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).count() == 6


def test_stream(spark, words, tmp_path):
    words.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(words.schema).parquet(str(tmp_path / "in"))
    q = counts.stream_context_counts(stream).writeStream.outputMode("complete").format("memory").queryName("contexts").start()
    q.processAllAvailable()
    q.stop()
    batch = ng.context_counts(words, ng.segments(F.col("form")), 1, 0)
    assert sorted(map(tuple, spark.table("contexts").collect())) == sorted(map(tuple, batch.collect()))


def test_whole_matrix_and_all_parts(spark):
    from glossarium import queries
    from glossarium.plans.views import wordlist

    words = wordlist(spark, "/root/testdata/sf0.001").collect()
    cells = queries.QUERIES["pivot_entries_all"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.concept, r.doculect, r.form) for r in cells) == sorted((r.concept, r.doculect, r.form) for r in words)
    parts = queries.QUERIES["partial_slices_all"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.id, r.part, r.morpheme) for r in parts) == sorted((r.id, k, m) for r in words for k, m in enumerate(r.form.split(" ")))


def test_multistate_beyond_the_symbols(spark):
    rows = [(k, f"d{k:02d}", "c", f"s{k:03d}") for k in range(70)]
    df = spark.createDataFrame(rows, "id long, doculect string, concept string, cogid string")
    states = {r.doculect: r.states for r in tb.multistate(df).collect()}
    assert len(set(states.values())) == 70 and states["d61"] == "9" and states["d62"] == "<63>"

"""Vector codes, periodic runs and language identification: against brute force, and on the cases that data bring."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossarium.llm import language_id, periodic_runs, simhash, vector_codes

# 11


@pytest.mark.parametrize("span", [2, 5, 1000, 2**33])
def test_nearest_is_that_of_all_distances(span):
    rng = np.random.default_rng(span)
    for n in (1, 3, 17, 60):
        entries, parts = rng.integers(-span, span, (n, 3)), rng.integers(-span, span, (80, 3))
        parts[:20] = entries[rng.integers(0, n, 20)]
        got, apart = vector_codes.nearest(vector_codes.kd_tree(entries), entries, parts)
        all_of_them = ((parts[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
        want = [min(range(n), key=lambda i: (row[i], i)) for row in all_of_them]
        assert got.tolist() == want
        assert apart.tolist() == [min(row[i], 2**63 - 1) for row, i in zip(all_of_them, want)]


def lloyd(rows, parts, size, rounds, scale):
    """rows: (id, vector), in order; codes and errors of each, and the entries."""
    scaled = [[int(np.floor(scale * float(np.float32(x)))) for x in v] for _, v in rows]
    width = len(scaled[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for v in scaled] for p in range(parts)]
    books = [own[:size] for own in cut]

    def assign():
        out = []
        for own, book in zip(cut, books):
            out.append([min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book)) for v in own])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                members = [v for v, (_, e) in zip(cut[p], found[p]) if e == k]
                if members:
                    books[p] = [*books[p][:k], [sum(c) // len(members) for c in zip(*members)], *books[p][k + 1 :]]
    found = assign()
    return [[found[p][i][1] for p in range(parts)] for i in range(len(rows))], [sum(found[p][i][0] for p in range(parts)) for i in range(len(rows))], books


def test_vector_codes(spark):
    rng = random.Random(3)
    good = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 2.0]) for _ in range(8)], i % 3 if i % 4 else None) for i in range(60)]
    bad = [(100, None, 1), (101, [], 1), (102, [1.0] * 7 + [None], 1), (103, [1.0] * 7 + [float("nan")], 2), (104, [float("inf")] + [0.0] * 7, 2), (105, [1.0] * 4, 0)]
    df = spark.createDataFrame(good + bad + [good[5]], "vec_id long, embedding array<float>, label int").withColumn("parts", F.lit(1)).withColumn("error", F.lit("x"))
    coded, books = vector_codes.compress_vectors(df, parts=2, size=6, rounds=3, scale=10)
    rows = sorted(coded.collect(), key=lambda r: r.vec_id)
    ordered = sorted([*good, good[5]], key=lambda r: (r[0], r[1]))
    codes, errors, entries = lloyd([(i, v) for i, v, _ in ordered], 2, 6, 3, 10)
    assert [r.vec_id for r in rows] == [i for i, _, _ in ordered]
    assert [list(r.codes) for r in rows] == codes and [r.error for r in rows] == errors
    assert [e.tolist() for e in books.entries] == entries
    total = {}
    for (_, _, label), e in zip(ordered, errors):
        total[label] = total.get(label, 0) + e
    assert [r.label_error for r in rows] == [total[label] for _, _, label in ordered]
    assert books.digest() == hashlib.sha256(",".join(str(x) for e in entries for row in e for x in row).encode()).hexdigest()


def test_vector_codes_of_nothing_and_of_wide_values(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 2)], [(1, [1.0, 2.0], 2)]):
        coded, books = vector_codes.compress_vectors(spark.createDataFrame(rows, schema))
        assert coded.count() == 0 and books is None
    wide = [(None, [3e38, 0.0, 1.0, 1.0], None), (2, [-1e12, 1e12, 0.0, 0.5], 1), (3, [1e9, -1e9, 0.0, 0.0], 1)]
    coded, books = vector_codes.compress_vectors(spark.createDataFrame(wide, schema), size=2)
    rows = {r.vec_id: r for r in coded.collect()}
    assert len(rows) == 3 and list(rows[2].codes)[0] == 0 and 0 < rows[None].error < 2**63


# 12


def naive_runs(words, least=12):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least and not any((i, j - i + q) == r[:2] for r in out):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    kind = rng.random()
    if kind < 0.1:
        a, b = "a", "b"
        while len(b) < 40:
            a, b = b, b + a
        return list(b)
    words = [rng.choice(rng.choice(["a", "ab", "abc", "abcdefgh"])) for _ in range(rng.randint(0, 60))]
    if kind < 0.6 and words:
        p, s = rng.randint(1, max(1, len(words) // 3)), rng.randint(0, len(words) - 1)
        words = words[:s] + [words[s + i % p] for i in range(len(words) - s)]
    return words


def test_runs_are_all_and_only_the_maximal_repetitions():
    rng = random.Random(7)
    for _ in range(300):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        x, starts = periodic_runs.numbered([[w.encode() for w in t] for t in texts])
        got = {tuple(r) for r in periodic_runs.runs_of(x).tolist()}
        assert got == {(a + int(s), n, q) for t, s in zip(texts, starts) for a, n, q in naive_runs(t, 2)}


def digest_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = naive_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_runs(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "one", "a " * 40, "x y " * 30 + "z", "la la la " * 20, "é 日本\x0bé 日本 " * 9, "many words of it " * 4000]
    texts += [" ".join(repetitive(rng)) for _ in range(120)]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(4, "a " * 40, 1, "x"), (None, "b c " * 20, 2, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(9, len(texts)))
    found = periodic_runs.run_digests(periodic_runs.find_runs(periodic_runs.with_planted_runs(df)))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=order) == sorted((digest_row(r[0], r[1]) for r in rows), key=order)
    assert periodic_runs.find_runs(df.limit(0)).count() == 0


# 13


def fewest_phrases(text, sample):
    n = i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, max(j, i + 1)
    return n


def pieces(text):
    """Lines in which all that stands between letters is one blank."""
    out, before = [], " "
    for line in re.split(r"(?<=\n)", text):
        kept = ""
        for c in map(language_id.folded, line):
            kept += "" if c == before == " " else c
            before = c
        out += [kept[i : i + language_id.PIECE] for i in range(0, len(kept), language_id.PIECE)]
    return out


def test_phrases_are_the_longest_stretches_known():
    rng = random.Random(2)
    samples = {n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(300)) for n, letters in (("x", "abcde"), ("y", "cdefgé"))}
    model = language_id.Languages.learn(samples)
    texts = ["", " ", "abc", "\n\nab\n cd", "ééa??ZZ 12 ç", "abcde " * 900 + "\nfg", "  gec"]
    texts += ["".join(rng.choice("abcdefgé \n.Q") for _ in range(rng.randint(0, 50))) for _ in range(200)]
    owner, size, counts = model.phrases(texts)
    got = sorted((int(o), int(n), *map(int, c)) for o, n, c in zip(owner, size, counts))
    plain = [language_id.plain(samples[n]) for n in model.names]
    assert got == sorted((k, len(p), *(fewest_phrases(p, s) for s in plain)) for k, t in enumerate(texts) for p in pieces(t))


def test_suffix_automaton_has_all_stretches_and_no_others():
    text = [0, 1, 0, 0, 1, 1, 0, 1, 0]
    table = language_id.suffix_automaton(text, 3)
    known = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
    paths, todo = set(), [(0, ())]
    while todo:
        state, path = todo.pop()
        paths.add(path)
        todo += [(int(t), (*path, c)) for c, t in enumerate(table[state]) if t >= 0]
    assert paths == known


def test_identify_languages(spark):
    rng = random.Random(4)
    words = {"en": "the of and thing ation ing wh er".split(), "de": "der die und schaft ung ein lich öß".split(), "fr": "le la des eau ment que ç é".split()}

    def text(lang, lines=4):
        return "\n".join(" ".join("".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 3))) for _ in range(12)) for _ in range(lines))

    rows = [(i, text(lang), lang, "s") for i in range(240) for lang in [("en", "de", "fr")[i % 3]]]
    quoting = text("en", 3) + "\n" + text("de", 1) * 3
    odd = [(300, None, "en", "s"), (301, "", None, "s"), (302, "12 -- *", "de", "s"), (303, quoting, None, "s"), (304, text("fr", 400), None, "s"), (None, "the thing", None, None), (0, rows[0][1], "en", "s")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = language_id.identify_languages(df.select("doc_id", "text", "score"), df.where(~apart))
    got = {r.doc_id: r for r in found.collect()}
    assert found.columns == ["doc_id", "lang_pred", "score"] and found.count() == len(rows) + len(odd)
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in rows) >= 0.99 * len(rows)
    assert [(got[k].lang_pred, got[k].score) for k in (300, 301, 302)] == [("und", 0.0)] * 3
    assert [got[k].lang_pred for k in (303, 304, None)] == ["en", "fr", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    wide = language_id.identify_languages(df, df.where(~apart), keep=True)
    assert wide.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {r.lang_pred for r in language_id.identify_languages(df, df.limit(0)).collect()} == {"und"}
    assert language_id.identify_languages(df.limit(0), df).count() == 0


# the pipeline's near-duplicates


def test_keep_one_with_clashing_names(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 1, 2, "x", 4), (2, text, 1, 2, "y", 5), (3, "quite " + text[::-1], 3, 3, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key int, __size int, __id string, root int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]

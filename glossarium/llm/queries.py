"""The thin queries opN_* over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, html_text, language_id, line_dedup, media, packing, periodic_runs, quality_rules, sharding, simhash, token_output, vector_codes
from .common import table


def held_out() -> F.Column:
    """True for the third of the ids whose labels are not learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op1_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_nearest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by its nearest labelled documents in the latent space."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = classifier.score_documents(docs, labels.where(~held_out()))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op3_host_suffix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k, and the text decoded from them, as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, digests=True)


def op5_training_order_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of 512 ids of every document: its slot in training order and its place in the shard files."""
    docs = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_output.write_shards(docs, token_output.shard_folder(docs), ranks, public_tokenizers.PATTERN)


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict by Jensen-Shannon distance from the language for every document."""
    rated = quality_rules.rate_documents(table(spark, sf_dir, "documents"))
    return rated.drop("class_distance", "word_distance")


def op7_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of word_bpe_49k ids in sequences of 2048."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 8, its slot there, and its shard of 9."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op9_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a recording: the classes that align with each query (ids divisible by 100), and the class of every recording."""
    return media.audio_search_members(table(spark, sf_dir, "embeddings"))


def op10_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat, or are within two edits of, an earlier line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op11_kd_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector as four codebook numbers, with its error and its label's."""
    coded, books = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    hexed = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    digest = F.lit(books.digest() if books else None).cast("string")
    return coded.select("vec_id", hexed.alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, of which a tenth repeat a stretch, as digests."""
    return periodic_runs.run_digests(periodic_runs.find_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))))


def op13_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by cross-parsing against labelled text; a quarter of the ids is not learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = language_id.identify_languages(docs.select("doc_id", "text"), docs.where(~apart))
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_pigeonhole, op2_nearest_quality, op3_host_suffix_text, op4_byte_bpe, op5_training_order_shards, op6_divergence_rules, op7_configuration_packing,
        op8_jump_sharding, op9_chroma_alignment, op10_segment_line_dedup, op11_kd_vector_codes, op12_periodic_runs, op13_cross_parsing_language,
    )
}


def _vector_code_sql(parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """SQL for op11: all distances of all parts in every round."""
    steps = [
        f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)
),
parts AS (
  SELECT k, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM (SELECT k, v, unnest(range({parts})) AS p FROM kept)
),
e0 AS (SELECT p, k - 1 AS e, x AS y FROM parts WHERE k <= {size})"""
    ]
    distance = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x, y)])::BIGINT"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT k, p, arg_min({{'e': e, 'd': {distance}}}, {{'d': {distance}, 'e': e}}) AS f FROM parts JOIN e{r} USING (p) GROUP BY k, p)")
        if r < rounds:
            steps.append(
                f"""s{r} AS (
  SELECT p, e, i, sum(c)::BIGINT AS s, count(*) AS n
  FROM (SELECT a.p, a.f.e AS e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS c FROM a{r} a JOIN parts USING (k, p)) GROUP BY p, e, i
),
m{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM s{r} GROUP BY p, e),
e{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.y, o.y) AS y FROM e{r} o LEFT JOIN m{r} m USING (p, e))"""
            )
    return (
        ",\n".join(steps)
        + f""",
digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM e{rounds}),
coded AS (
  SELECT k, string_agg(printf('%02x', f.e), '' ORDER BY p) AS code, sum(f.d)::BIGINT AS error FROM a{rounds} GROUP BY k
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (k) CROSS JOIN digest
"""
    )


ORACLES: dict[str, str] = {
    "op6_divergence_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws
  FROM documents
),
tokens AS (SELECT k, lang, unnest(ws) AS word FROM d),
freq AS (SELECT lang, word, count(*) AS n FROM tokens GROUP BY ALL),
top AS (SELECT lang, word, n FROM freq QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 30),
totals AS (SELECT lang, sum(n) AS total FROM freq GROUP BY 1),
ref_words AS (
  SELECT lang, word, n / total AS q FROM top JOIN totals USING (lang)
  UNION ALL SELECT lang, NULL, 1 - sum(n) / any_value(total) FROM top JOIN totals USING (lang) GROUP BY lang
),
doc_words AS (
  SELECT k, x.lang, t.word, count(*) AS n FROM tokens x LEFT JOIN top t ON x.lang = t.lang AND x.word = t.word GROUP BY ALL
),
word_bins AS (
  SELECT d.k, r.q, coalesce(w.n, 0) / greatest(len(d.ws), 1) AS p
  FROM d JOIN ref_words r USING (lang) LEFT JOIN doc_words w ON w.k = d.k AND w.word IS NOT DISTINCT FROM r.word
),
classed AS (
  SELECT k, lang, length(text) AS n, unnest([0, 1, 2, 3, 4, 5]) AS class, unnest([
    length(text) - length(regexp_replace(text, '[\p{Ll}]', '', 'g')), length(text) - length(regexp_replace(text, '[\p{Lu}]', '', 'g')),
    length(text) - length(regexp_replace(text, '[\p{Nd}]', '', 'g')), length(text) - length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')),
    length(text) - length(regexp_replace(text, '[.,;:''"?!()-]', '', 'g')), length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))]) AS c
  FROM d
),
classes AS (SELECT * FROM classed UNION ALL SELECT k, lang, any_value(n), 6, any_value(n) - sum(c) FROM classed GROUP BY k, lang),
ref_classes AS (SELECT lang, class, s / sum(s) OVER (PARTITION BY lang) AS q FROM (SELECT lang, class, sum(c) AS s FROM classes GROUP BY lang, class)),
class_bins AS (SELECT c.k, r.q, c.c / greatest(c.n, 1) AS p FROM classes c JOIN ref_classes r USING (lang, class)),
word_distance AS (
  SELECT k, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS wd FROM word_bins GROUP BY k
),
class_distance AS (
  SELECT k, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS cd FROM class_bins GROUP BY k
),
windows AS (SELECT k, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
repeated AS (SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
hits AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM repeated) GROUP BY 1),
lines AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY 1),
counted AS (
  SELECT d.k, d.doc_id, len(ws) AS n_words, length(text) - length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) AS n_spaces, length(text) AS n_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines l USING (k) LEFT JOIN hits h USING (k)
)
SELECT doc_id, n_words, n_chars - n_spaces AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND cd <= 0.19 + 0.5 / sqrt(n_words) AND wd <= 0.17 + 2 / sqrt(n_words) AS kept
FROM counted JOIN class_distance USING (k) LEFT JOIN word_distance USING (k)
""",
    # every pair of distinct lines of near lengths; one of three parts of the shorter must be in the longer
    "op10_segment_line_dedup": """
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, i - 1 AS pos, ls[i] AS line
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts)
),
firsts AS (
  SELECT line, min({'d': doc_id, 'p': pos}) AS place, length(line) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY line
),
longs AS (SELECT line, place, n, unnest([n, n - 1, n - 2]) AS m FROM firsts WHERE n >= 20),
pairs AS (
  SELECT a.line AS one, b.line AS other, a.place AS p, b.place AS q
  FROM longs a JOIN firsts b ON a.m = b.n AND b.n >= 20 AND a.line <> b.line
  WHERE (contains(a.line, substr(b.line, 1, b.n // 3)) OR contains(a.line, substr(b.line, b.n // 3 + 1, b.n // 3))
    OR contains(a.line, substr(b.line, 2 * (b.n // 3) + 1)))
    AND levenshtein(a.line, b.line) <= 2
),
near AS (SELECT DISTINCT CASE WHEN q < p THEN one ELSE other END AS line FROM pairs),
marked AS (
  SELECT l.doc_id, l.pos, l.line, trim(l.line, ' ') = '' AS blank,
    f.place IS NOT NULL AND (f.place.d <> l.doc_id OR f.place.p <> l.pos) AS again, n.line IS NOT NULL AS near
  FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.line
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT again AND NOT near), '') AS text,
  count(*) FILTER (WHERE NOT blank) AS n_lines, count(*) FILTER (WHERE again) AS n_exact,
  count(*) FILTER (WHERE near AND NOT again) AS n_near
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0, 0 FROM documents WHERE text IS NULL
""",
    "op11_kd_vector_codes": _vector_code_sql(),
    # every two equal words of a document and how far they are apart: stretches of places with one such distance are runs
    "op12_periodic_runs": r"""
WITH crc AS (
  SELECT row_number() OVER () AS k, doc_id, text,
    xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')]),
      lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS h
  FROM documents
),
split AS (SELECT k, doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM crc),
sized AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM split),
planted AS (
  SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1:a], [w[a + 1 + j % (1 + (n - a) // (3 + g % 8))] for j in range(n - a)]) END AS w FROM sized
),
words AS (SELECT k, unnest(range(n)) AS i, unnest(w) AS word FROM planted),
pairs AS (SELECT x.k, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.k = y.k AND x.word = y.word AND x.i < y.i),
islands AS (SELECT k, q, min(i) AS start, count(*) AS c FROM (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM pairs) GROUP BY k, q, island),
runs AS (SELECT k, start, c + q AS length, min(q) AS period FROM islands WHERE c >= q AND c + q >= 12 GROUP BY ALL),
best AS (
  SELECT k, count(*) AS n_runs, min({'l': -length, 's': start, 'p': period}) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY k
),
gone AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, -b.l AS length, b.p AS period, 1000 * -b.l // b.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM planted LEFT JOIN best USING (k) LEFT JOIN kept USING (k)
""",
}

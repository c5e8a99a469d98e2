"""Quality rules: base counts, and divergence from references of the document's language.

A document is compared with its language by two histograms: character classes,
and the language's most common words (all others in one bin). The distance is
that of Jensen and Shannon (square root of the divergence in bits, 0 to 1).
References are made from all documents of a language. A short text differs
from any reference by chance, so a text that is shorter than the minimum
passes, and the limit has a part that falls with the root of the length.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import blocks, forget

#: Fixed values of the base rules: characters that count as symbols, and ASCII white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Names of the character classes.
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other")

#: Punctuation that counts as marks.
MARKS = ".,;:'\"?!()-"


@cache
def class_table() -> np.ndarray:
    """The class of every code point: lower and upper letters and digits by Unicode category (Ll, Lu, Nd)."""
    kinds = {"Ll": 0, "Lu": 1, "Nd": 2}
    table = np.array([kinds.get(unicodedata.category(chr(i)), 6) for i in range(0x110000)], np.uint8)
    for k, chars in ((3, SPACES), (4, MARKS), (5, SYMBOLS)):
        table[[ord(c) for c in chars]] = k
    return table


def numbered(words: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """Numbers of the distinct words, by first place, and the text in these numbers."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return number, np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def repeated_words(code: np.ndarray, distinct: int) -> int:
    """Words that lie in a 3-word window found twice or more in the text, its first place included."""
    n = len(code)
    if n < 4:
        return 0
    pairs = code[:-2] * distinct + code[1:-1]
    if distinct > 1 << 20:  # three numbers no longer fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * distinct + code[2:]
    ranked = np.sort(windows)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    at = np.isin(windows, twice)
    hit = np.zeros(n, bool)
    for shift in range(3):
        hit[shift : shift + n - 2] |= at
    return int(hit.sum())


def base_counts(text: str, code: np.ndarray, distinct: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; code: its words as numbers."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(code),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(code, distinct),
    )


def class_counts(text: str) -> np.ndarray:
    """Characters of each of CLASSES in the text."""
    return np.bincount(class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=len(CLASSES))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p from the counts q, 0 to 1; a row without counts has distance 0."""
    p, q = np.atleast_2d(p).astype(float), np.asarray(q, float)
    total = p.sum(axis=1, keepdims=True)
    p = np.divide(p, total, out=np.zeros_like(p), where=total > 0)
    q = q / max(q.sum(), 1.0)
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        x = np.broadcast_to(x, m.shape)
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    return np.where(total[:, 0] > 0, np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1)), 0.0)


def references(docs: DataFrame, lang_col: str, text_col: str, common: int) -> dict[str, tuple[list[bytes], np.ndarray, np.ndarray]]:
    """By language, over all its documents: the common words, their counts with the rest last, the class counts.

    The driver gets common + 1 rows for each language, never a vocabulary. Null
    language: a language of its own (""). Ties of equally common words go by
    the word.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in words.items() for w, n in c.items()]
            rows += [(lang, bytes([10, k]), int(n)) for lang, c in classes.items() for k, n in enumerate(c)]
            words.clear(), classes.clear()
            lang, key, n = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(key, pa.binary()), pa.array(n, pa.int64())], ["lang", "key", "n"])

        forget()
        for batch, texts in blocks(batches, 1, 1 << 22):
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                lang = lang or ""
                words.setdefault(lang, Counter()).update(text.encode("utf-8", "surrogatepass").split())
                classes[lang] = classes.get(lang, 0) + class_counts(text)
            if sum(map(len, words.values())) > 300_000:
                yield flush()
        yield flush()

    counts = (
        docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(partial, "lang string, key binary, n bigint")
        .groupBy("lang", "key")
        .agg(F.sum("n").alias("n"))
    )
    # a key that starts with a line end is a class: no word has one
    is_class = F.ascii(F.substring("key", 1, 1).cast("string")) == 10
    # the most common words are found by salted top lists, then a top list of these
    salted = Window.partitionBy("lang", "is_class", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(F.desc("n"), "key")
    among = Window.partitionBy("lang", "is_class").orderBy(F.desc("n"), "key")
    counts = counts.withColumn("is_class", is_class)
    totals = counts.groupBy("lang", "is_class").agg(F.sum("n").alias("total"))
    top = (
        counts.withColumn("r", F.row_number().over(salted))
        .where(F.col("r") <= common)
        .withColumn("r", F.row_number().over(among))
        .where(F.col("r") <= common)
        .join(F.broadcast(totals), ["lang", "is_class"])
    )
    out: dict[str, tuple[list[bytes], np.ndarray, np.ndarray]] = {}
    for lang, rows in top.toPandas().groupby("lang"):
        w = rows[~rows.is_class].sort_values("r")
        words = [bytes(k) for k in w.key]
        total = int(w.total.iloc[0]) if len(w) else 0
        classes = np.zeros(len(CLASSES))
        for k, n in zip(rows[rows.is_class].key, rows[rows.is_class].n):
            classes[bytes(k)[1]] = n
        out[lang] = words, np.array([*w.n, total - int(w.n.sum())], float), classes
    return out


def rate_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    common: int = 30,
    min_words: int = 50,
    class_limit: float = 0.19,
    word_limit: float = 0.17,
    slack: float = 2.0,
    keep: bool = False,
) -> DataFrame:
    """Base counts, both distances and the verdict for every row.

    Result: id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed (fewer than min_words words, or over half of
    them repeated), class_distance, word_distance, kept. With keep=True the
    columns of docs come first, so that a stage can filter on kept.

    kept is false if base_failed, or if class_distance is over class_limit +
    slack / (4 * root of n_words), or word_distance over word_limit + slack /
    root of n_words. A text under min_words gets no distance verdict (it is
    base_failed). Null or empty text: no words, base_failed. Null language: a
    language of its own. Repeated rows: one result each. No rows: no rows.
    Columns of docs that are named like one of the result's give way to it.
    """
    spark = docs.sparkSession
    added = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, class_distance double, word_distance double, kept boolean"
    docs = docs.drop(*(x.split()[0] for x in added.split(", ")))
    shared = spark.sparkContext.broadcast(references(docs, lang_col, text_col, common))
    source = docs if keep else docs.select(*dict.fromkeys([id_col, text_col, lang_col]))
    names = source.columns
    text_at, lang_at = names.index(text_col), names.index(lang_col)
    first = source.schema if keep else docs.select(id_col).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in first), added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = shared.value
        forget()
        for batch, texts in blocks(batches, text_at, 1 << 22):
            langs = [x or "" for x in batch.column(lang_at).cast(pa.string()).to_pylist()]
            counts, classes, commons = [], [], []
            for text, lang in zip(texts, langs):
                words = text.encode("utf-8", "surrogatepass").split()
                number, code = numbered(words)
                counts.append(base_counts(text, code, len(number)))
                classes.append(class_counts(text))
                times = np.append(np.bincount(code, minlength=len(number)), 0)
                found = times[[number.get(w, -1) for w in reference[lang][0]]]
                commons.append(np.append(found, len(code) - found.sum()))
            frame = pd.DataFrame(counts, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            frame["base_failed"] = (frame.n_words < min_words) | (100 * frame.n_repeat_words > 50 * frame.n_words)
            frame["class_distance"] = frame["word_distance"] = 0.0
            for lang in set(langs):
                rows = [i for i, x in enumerate(langs) if x == lang]
                frame.loc[rows, "class_distance"] = js_distance(np.array([classes[i] for i in rows]), reference[lang][2])
                frame.loc[rows, "word_distance"] = js_distance(np.array([commons[i] for i in rows]), reference[lang][1])
            root = np.sqrt(frame.n_words.clip(lower=1))
            frame["kept"] = ~frame.base_failed & (frame.class_distance <= class_limit + slack / 4 / root) & (frame.word_distance <= word_limit + slack / root)
            columns = batch.columns if keep else [batch.column(0)]
            result = pa.RecordBatch.from_pandas(frame, preserve_index=False)
            yield pa.RecordBatch.from_arrays([*columns, *result.columns], [*first.names, *result.schema.names])

    return source.mapInArrow(run, schema)

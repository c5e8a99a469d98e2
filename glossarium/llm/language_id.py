"""Language identification by cross-parsing entropy (Ziv and Merhav, 1993).

Labelled text of each language becomes a suffix automaton: the paths from its
root are all stretches of that text. A document's lines are parsed against each
automaton into the longest stretches that it knows; the language that needs the
fewest phrases, in bits for each character, wins the line, and that with most
votes of lines wins. Automata are broadcast as
dense tables whose entries already hold the restart after a phrase's end, so a
step is one lookup, and many pieces of text take it side by side.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import blocks, forget

#: Characters of a line after which a phrase ends in any case: lines, and pieces of this length of longer ones, are parsed side by side.
PIECE = 2048
#: Votes that a piece has at most.
VOTES = 100
#: Bytes of text that are worked off at once.
BLOCK = 1 << 23
#: Symbols of an automaton at most, the last one for all characters that are not among them.
SYMBOLS = 256
UNDETERMINED = "und"


def folded(c: str) -> str:
    """Lower case of a letter or mark, a blank for all else."""
    return c.lower()[0] if unicodedata.category(c)[0] in "LM" else " "


def plain(text: str) -> str:
    """Folded text, in which all that stands between letters is one blank."""
    return re.sub(" +", " ", "".join(map(folded, text)))


def suffix_automaton(codes: list[int], symbols: int) -> np.ndarray:
    """Table (states x symbols) of the next state, -1 for none, of the suffix automaton (Blumer et al., 1985) of the codes; state 0 is the root."""
    after: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(after)
                after.append(after[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.full((len(after), symbols), -1, np.int32)
    state = np.repeat(np.arange(len(after)), [len(x) for x in after])
    table[state, np.fromiter((c for x in after for c in x), np.int64, len(state))] = np.fromiter((t for x in after for t in x.values()), np.int64, len(state))
    return table


def parser(table: np.ndarray) -> np.ndarray:
    """Flat table: entry state * symbols + c is 4 * symbols * next state plus the phrases that c ends.

    Where the state does not know c, a phrase ends before it and the next one
    begins with c; a character that the root does not know is a phrase of its own.
    """
    root, step = table[0], 4 * table.shape[1]
    unknown = np.where(root >= 0, root * step + 1, 2)
    out = np.where(table >= 0, table * step, unknown)
    out[0] = np.where(root >= 0, root * step, 1)
    return out.astype(np.int32).reshape(-1)


@dataclass
class Languages:
    """The broadcast model, of a size that the sample's bound fixes."""

    names: list[str]
    codes: np.ndarray
    blank: int
    tables: list[np.ndarray]
    sizes: list[int]

    @classmethod
    def learn(cls, texts: dict[str, str]) -> Languages:
        """From each language's sample text."""
        names = sorted(texts)
        spelled = {n: plain(texts[n]) for n in names}
        count = Counter()
        for text in spelled.values():
            count.update(text)
        common = sorted(count, key=lambda c: (c != " ", -count[c], c))[: SYMBOLS - 1]
        number = {c: i for i, c in enumerate(common)}
        codes = np.full(0x110000, len(common), np.uint8)
        for point in range(0x110000):
            if not 0xD800 <= point < 0xE000 and (got := number.get(folded(chr(point)))) is not None:
                codes[point] = got
        symbols = len(common) + 1
        tables = [parser(suffix_automaton([number.get(c, len(common)) for c in spelled[n]], symbols)) for n in names]
        return cls(names, codes, int(codes[32]), tables, [len(spelled[n]) for n in names])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every piece (a line, or PIECE characters of a longer one) of the texts: its text's number, its length, and its phrases (pieces x languages)."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        line = np.unique(np.concatenate([[0], ends, np.flatnonzero(points == 10) + 1]))[:-1]
        codes = self.codes[points].astype(np.int32)
        # all that stands between two letters is one blank; none begins a text
        blank = codes == self.blank
        kept = ~blank
        kept[1:] |= blank[1:] & ~blank[:-1]
        heads = np.append(0, ends[:-1])
        heads = heads[heads < len(points)]
        kept[heads] = ~blank[heads]
        place = np.concatenate([[0], np.cumsum(kept)])
        codes, line, ends = codes[kept], np.unique(place[line]), place[ends]
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(self.names)), np.int64)
        line = line[line < len(codes)]
        sizes = np.diff(line, append=len(codes))
        pieces = -(-sizes // PIECE)
        within = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(line, pieces) + within * PIECE
        size = np.minimum(np.repeat(sizes, pieces) - within * PIECE, PIECE)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        # pieces longer than t are the first live[t]
        live = (len(size) - np.cumsum(np.bincount(size, minlength=PIECE + 1)))[: int(size[0])].tolist()
        counts = np.zeros((len(self.names), len(size)), np.int32)
        state = np.zeros((len(self.names), len(size)), np.int32)
        at, ended = np.empty(len(size), np.int32), np.empty(len(size), np.int32)
        for t, w in enumerate(live):
            c = codes[begin[:w] + t]
            for table, s, n in zip(self.tables, state, counts):
                np.add(s[:w], c, out=at[:w])
                np.take(table, at[:w], out=s[:w], mode="clip")
                np.bitwise_and(s[:w], 3, out=ended[:w])
                n[:w] += ended[:w]
                s[:w] >>= 2
        counts += state != 0  # the phrase that the piece's end cuts off
        return np.searchsorted(ends, begin, "right"), size, counts.T

    def votes(self, texts: list[str], sharpness: float) -> np.ndarray:
        """Share of each language in each text (texts x languages): its pieces vote for the languages that need few bits for them.

        A piece has as many votes as letters and blanks, VOTES at most, so that one
        long quotation in another language does not outvote the lines around it.
        A phrase is worth the logarithm of its language's sample size in bits; a
        piece's share of a language is that of the weights 2^(-sharpness * bits a character).
        """
        owner, size, counts = self.phrases(texts)
        bits = counts * np.log2(np.maximum(self.sizes, 2)) / size[:, None]
        weights = np.exp2(-sharpness * (bits - bits.min(axis=1, keepdims=True)))
        weights *= (np.minimum(size, VOTES) / weights.sum(axis=1))[:, None]
        total = np.stack([np.bincount(owner, w, minlength=len(texts)) for w in weights.T], axis=1)
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def language_sample(docs: DataFrame, texts: int, chars: int, languages: int, id_col: str, text_col: str, lang_col: str) -> dict[str, str]:
    """Sample text of each language: distinct labelled texts in the order of their hash, texts of them and chars characters at most.

    These bounds, and that of languages (the most frequent ones), are what is
    collected at most; a rate for each language lets about as many rows through
    as are wanted, so that no group is sorted or gathered. The sample's last
    text is cut where chars are full.
    """
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.withColumn("hash", F.xxhash64("text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("distinct")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return {}
    # about 2 * texts hashes of each language are below its limit
    limit = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(r["distinct"], 2 * texts) * (2**63 - 1) // r["distinct"])])
    chosen = known.where(F.col("hash").bitwiseAND(F.lit(2**63 - 1)) <= limit[F.col("lang")])
    rows = chosen.groupBy("lang", "hash").agg(F.min(F.substring("text", 1, chars)).alias("text")).orderBy("hash", "lang").limit(4 * texts * languages)
    out: dict[str, list[str]] = {r["lang"]: [] for r in sizes}
    for row in rows.toLocalIterator():
        own = out[row["lang"]]
        if len(own) < texts and sum(map(len, own)) < chars:
            own.append(row["text"])
    return {lang: "\n".join(own)[:chars] for lang, own in out.items() if own}


def identify_languages(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    texts: int = 64,
    chars: int = 1 << 16,
    languages: int = 64,
    sharpness: float = 6.0,
    keep: bool = False,
) -> DataFrame:
    """lang_pred and score (0 to 1) of every row's whole text.

    labelled: the rows to learn from, already held apart from those to be
    judged; at most texts texts and chars characters of each language are used,
    and the languages most frequent ones (the documented bounds of the sample).
    Each line is parsed by itself, longer ones in pieces of PIECE characters;
    lang_pred is the language with the largest share of the votes of all pieces
    (ties: the first by name), score that share.
    Null text, text without a letter, and all text where nothing is learnt:
    "und" with score 0. Repeated rows give one result each. No rows: no rows. Result: id_col, lang_pred, score, or with keep=True all columns of
    docs (but for old ones of these names) and these two.
    """
    docs = docs.drop("lang_pred", "score")
    sample = language_sample(labelled, texts, chars, languages, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(Languages.learn(sample) if sample else None)
    source = docs if keep else docs.select(*dict.fromkeys([id_col, text_col]))
    at = source.columns.index(text_col)
    first = source.schema if keep else docs.select(id_col).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in first), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        forget()
        for batch, some in blocks(batches, at, BLOCK):
            lettered = np.array([model is not None and (t.isalpha() or any(map(str.isalpha, t))) for t in some], bool)
            names, score = np.full(len(some), UNDETERMINED, object), np.zeros(len(some))
            if lettered.any():
                shares = model.votes([t for t, yes in zip(some, lettered) if yes], sharpness)
                # equal up to rounding is equal: the first name wins
                names[lettered] = np.array(model.names, object)[np.round(shares, 9).argmax(axis=1)]
                score[lettered] = shares.max(axis=1).clip(0, 1)
            columns = batch.columns if keep else [batch.column(0)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score)], [*first.names, "lang_pred", "score"])

    return source.mapInArrow(run, schema)

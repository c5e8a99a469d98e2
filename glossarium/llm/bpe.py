"""Byte-level BPE by corpus-level merge replay, and its inverse.

The distinct new pre-tokens of a block of documents are laid out in one array
of symbols. An inverted index leads from each rank to the positions of its
pair in all words. Ranks come from a heap, lowest first; a merge is applied at
all its positions at once and touches only their two neighbours, whose new
pairs join the index. What a word became stays in a bounded cache of the
worker, so a frequent word is merged about once, and texts never leave the
task that read them: there is no shuffle.
"""

from __future__ import annotations

import base64
import ctypes
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Entries of a worker's cache; it is emptied beyond that (memory, not results).
CACHE_ENTRIES = 400_000
_SHIFT = 18
_NONE = (1 << _SHIFT) - 1
_NEVER = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file of lines "base64-token rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merges:
    """Pairs of symbol ids with their rank, and the id that each rank makes.

    first: symbol ids of the 256 bytes; last: those of bytes that end a word.
    """

    def __init__(self, pairs: dict[tuple[int, int], int], made: np.ndarray, first: np.ndarray, last: np.ndarray):
        keys = np.array([a << _SHIFT | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(pairs.values()), np.int32)[order]
        self.made, self.first, self.last = made, first, last

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Merges:
        """Two symbols merge if their bytes joined are a token; its rank is its id."""
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        return cls(pairs, np.arange(max(ranks.values()) + 1, dtype=np.int32), single, single)

    @classmethod
    def of_tokenizer(cls, config: dict) -> Merges:
        """From a tokenizers file of byte-level BPE with a mark at word ends: the order of its merges is their rank."""
        vocab, end = config["model"]["vocab"], config["model"]["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in config["model"]["merges"]]
        pairs = {}
        for rank, (a, b) in enumerate(merges):
            pairs.setdefault((vocab[a], vocab[b]), rank)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        letters = byte_letters()
        return cls(pairs, made, np.array([vocab[x] for x in letters], np.int32), np.array([vocab[x + end] for x in letters], np.int32))

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << _SHIFT | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and where each word's begin (and the last ends).

        One round takes the lowest rank left and merges, in each word that has
        it, its leftmost pair; so a pair of lower rank that comes up goes first,
        as if every word were encoded alone.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(text), np.cumsum(lengths)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        symbol = np.append(self.first[text], np.int32(_NONE))
        filled = ends[lengths > 0]
        symbol[filled - 1] = self.last[text[filled - 1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[filled - 1] = n
        before[filled - lengths[lengths > 0]] = n
        alive = np.ones(n, bool)
        rank_at = np.append(self.lookup(symbol[:n], symbol[after[:n]]), _NEVER)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(ranks: np.ndarray, at: np.ndarray) -> None:
            keep = ranks != _NEVER
            ranks, at = ranks[keep], at[keep]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for rank, x, y in zip(ranks[edges[:-1]].tolist(), edges, edges[1:]):
                if rank in index:
                    index[rank].append(at[x:y])
                else:
                    index[rank] = [at[x:y]]
                    heappush(heap, rank)

        note(rank_at[:n], np.arange(n))
        heapify(heap)
        while heap:
            rank = heappop(heap)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            at = np.sort(at)
            word = owner[at]
            later = np.flatnonzero(word[1:] == word[:-1]) + 1
            if len(later):
                index[rank] = [at[later]]
                heappush(heap, rank)
                at = np.delete(at, later)
            gone, left = after[at], before[at]
            right = after[gone]
            symbol[at] = self.made[rank]
            alive[gone] = False
            rank_at[gone] = _NEVER
            after[at] = right
            before[right] = at
            rank_at[at] = new = self.lookup(symbol[at], symbol[right])
            rank_at[left] = old = self.lookup(symbol[left], symbol[at])
            rank_at[n] = _NEVER
            note(np.concatenate([new, np.where(left == n, _NEVER, old)]), np.concatenate([at, left]))
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(owner[alive], minlength=len(words)), out=starts[1:])
        return symbol[:n][alive], starts


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class BlockEncoder:
    """Encodes texts to packed ids of one numpy type by a pre-token pattern and Merges.

    The pattern must be one of those that start a match at every blank after a
    non-space and never cross it, as byte-level tokenizers' do: then the parts
    between such blanks are encoded alone, and frequent ones but once.
    """

    def __init__(self, merges: Merges, pattern: str, dtype: str = "<u4"):
        self.merges, self.dtype = merges, np.dtype(dtype)
        self.split = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        #: parts after a blank; None: ends in white space, so what follows matters
        self.parts: dict[str, bytes | None] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.words) > CACHE_ENTRIES // 2:
            self.words.clear()
        new = sorted(words - self.words.keys())
        ids, starts = self.merges.replay([w.encode() for w in new])
        packed, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        edges = (starts * width).tolist()
        self.words.update({w: packed[a:b] for w, a, b in zip(new, edges, edges[1:])})

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.parts) > CACHE_ENTRIES:
            self.parts.clear()
        split = [t.split(" ") for t in texts]
        heads = [self.split(s[0]) for s in split]
        new = set().union(*(s[1:] for s in split)) - self.parts.keys()
        found = {x: self.split(" " + x) for x in new if x and not x[-1].isspace()}
        self.learn(set().union(*heads, *found.values()))
        word, part = self.words.__getitem__, self.parts.__getitem__
        for x in new:
            self.parts[x] = b"".join(map(word, found[x])) if x in found else None
        packed = [b"".join(map(word, h)) for h in heads]
        out = []
        for text, s, head in zip(texts, split, packed):
            try:
                if len(s) > 1 and s[0][-1:].isspace():
                    raise TypeError
                out.append(head + b"".join(map(part, s[1:])))
            except TypeError:
                whole = self.split(text)
                self.learn(set(whole))
                out.append(b"".join(map(self.words.__getitem__, whole)))
        return out


class WordEncoder(BlockEncoder):
    """For tokenizers that normalise to NFC and lower case and drop white space.

    White space always parts tokens, so whole space-separated words are cached.
    Lower-casing goes letter by letter (no final-sigma rule).
    """

    def __init__(self, merges: Merges, pattern: str, dtype: str = "<u4"):
        super().__init__(merges, pattern + r"|\n", dtype)
        self.whole: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.encode().split() for t in texts]
        if len(self.whole) > CACHE_ENTRIES:
            self.whole.clear()
        new = list(set().union(*split) - self.whole.keys())
        # all new words as lines of one text: the line ends come back as ids of their own, which mark the words' ends
        lines = b"\n".join(new).decode()
        if not lines.isascii():
            lines = unicodedata.normalize("NFC", lines).replace("Σ", "σ")
        parts = self.split(lines.lower())
        self.learn(set(parts) - {"\n"})
        self.words["\n"] = np.array([-1]).astype(self.dtype).tobytes()
        packed, width = b"".join(map(self.words.__getitem__, parts)), self.dtype.itemsize
        ends = np.flatnonzero(np.frombuffer(packed, self.dtype) == np.array([-1]).astype(self.dtype)[0]) * width
        self.whole.update({w: packed[x:y] for w, x, y in zip(new, [0, *(ends + width).tolist()], [*ends.tolist(), len(packed)])})
        whole = self.whole.__getitem__
        return [b"".join(map(whole, s)) for s in split]


def word_encoder(tokenizer: str, dtype: str = "<u4") -> WordEncoder:
    """From the text of a tokenizers file: byte-level BPE with word ends, lower case, white space dropped."""
    config = json.loads(tokenizer)
    pattern = next(p["pattern"]["Regex"] for p in config["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return WordEncoder(Merges.of_tokenizer(config), pattern, dtype)


def blocks(batches: Iterator[pa.RecordBatch], text: int, size: int = 1 << 24) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches of about size bytes of text, one row at least, with their texts (null: empty)."""
    part = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths) // size
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            part = batch.slice(a, b - a)
            yield part, [x or "" for x in part.column(text).to_pylist()]
        part = None
    release()


def release() -> None:
    """Hands freed memory back to the system: later stages use the same workers, and what their allocators hold is the executor's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What this worker has made for key, kept from task to task."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what an earlier stage has kept in this worker; for stages that keep nothing."""
    _KEPT.clear()


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u4", digests: bool = False
) -> DataFrame:
    """id_col, n_tokens, ids (binary, packed by dtype), decoded (binary) of every row.

    The rank file is read on the driver and broadcast: its size is that of the
    vocabulary, whatever the corpus. Null and empty texts have no tokens; very
    long ones are a block of their own. Rows with equal ids or texts each give a
    row, other columns are not used, no rows give no rows. With digests=True,
    ids and decoded give way to their SHA-256 in hex (ids_sha256,
    decoded_sha256), so that nothing long leaves the worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    source = docs.select(id_col, text_col)
    key = source.schema[id_col].dataType.simpleString()
    columns = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"

    def make() -> tuple[BlockEncoder, dict[int, bytes]]:
        ranks = shared.value
        return BlockEncoder(Merges.of_ranks(ranks), pattern, dtype), {i: t for t, i in ranks.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = kept((ranks_path, pattern, dtype), make)
        token = tokens.__getitem__
        for batch, texts in blocks(batches, 1, 1 << 23):
            packed = encoder.encode(texts)
            decoded = (b"".join(map(token, np.frombuffer(p, encoder.dtype).tolist())) for p in packed)
            counts = pa.array([len(p) // encoder.dtype.itemsize for p in packed], pa.int64())
            if digests:
                last = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (packed, decoded)]
            else:
                last = [pa.array(packed, pa.binary()), pa.array(list(decoded), pa.binary())]
            names = [x.split()[0] for x in columns.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, *last], [id_col, "n_tokens", *names])

    return source.mapInArrow(run, f"`{id_col}` {key}, n_tokens bigint, {columns}")

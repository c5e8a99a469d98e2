"""Media columns: chroma fingerprints of audio, and alignment of recordings.

Audio becomes frames of twelve pitch classes. Filters that compare rectangles of
this picture (time x pitch class) are read off its integral image; each gives
two bits in Gray code, and sixteen of them make one 32-bit integer a frame.
Recordings that share integers are aligned by the histogram of the offsets at
which they do, and verified by the share of bits that differ over the overlap.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Frame length and step in samples, and the octaves that count, from this frequency on.
FRAME, STEP, LOWEST, OCTAVES = 2048, 512, 110.0, 4
#: Frames that the widest filter covers.
SPAN = 8
#: Recordings of a class that one task joins to it.
CLASS_ROWS = 1024


def filter_bank() -> list[tuple[int, int, int, int]]:
    """Sixteen filters as (kind, first pitch class, pitch classes, frames), by a rule: kinds, heights and widths in turn around the octave."""
    return [(k % 4, (5 * k) % 12, 2 + k % 3 * 2, SPAN if k % 2 else SPAN // 2) for k in range(16)]


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (mono, -1 to 1) and rate of a WAV file of 16 bits; null, broken or empty files have no samples."""
    try:
        with wave.open(io.BytesIO(data or b"")) as f:
            raw = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(np.float32) / 32768
            return (raw.reshape(-1, f.getnchannels()).mean(axis=1) if f.getsampwidth() == 2 else raw[:0]), f.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0, np.float32), 1


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, each frame of length one; silent frames are zero."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::STEP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    bands = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = (bands >= LOWEST) & (bands < LOWEST * 2**OCTAVES)
    classes = np.rint(12 * np.log2(bands[heard] / LOWEST)).astype(int) % 12
    picture = power[:, heard] @ np.eye(12)[classes]
    return picture / np.maximum(np.linalg.norm(picture, axis=1, keepdims=True), 1e-9)


def fingerprint(data: bytes | None) -> np.ndarray:
    """Packed integers, one for each position of the widest filter; none for audio that is too short."""
    picture = chroma(*read_wav(data))
    n = len(picture) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    # twice the octave, so that a filter may run past its end
    integral = np.zeros((len(picture) + 1, 25))
    integral[1:, 1:] = np.concatenate([picture, picture], axis=1).cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def box(t: int, frames: int, low: int, classes: int) -> np.ndarray:
        a, b = at + t, at + t + frames
        return integral[b, low + classes] - integral[a, low + classes] - integral[b, low] + integral[a, low]

    packed = np.zeros(n, np.uint32)
    for kind, low, classes, frames in filter_bank():
        half_t, half_c = frames // 2, classes // 2
        whole = box(0, frames, low, classes)
        if kind == 0:  # earlier against later
            part = box(0, half_t, low, classes)
        elif kind == 1:  # lower against higher pitch classes
            part = box(0, frames, low, half_c)
        elif kind == 2:  # crosswise
            part = box(0, half_t, low, half_c) + box(half_t, frames - half_t, low + half_c, classes - half_c)
        else:  # the middle third of the time against the rest, by their shares
            part = box(frames // 3, frames - 2 * (frames // 3), low, classes) * 1.2
        value = np.log((1e-3 + part) / (1e-3 + np.maximum(whole - part, 0)))
        level = np.digitize(value, [-0.5, 0.0, 0.5])
        packed = packed << np.uint32(2) | np.array([0, 1, 3, 2], np.uint32)[level]
    return packed


def fingerprints(recordings: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """id_col and fp (array<int>) of every row; null or broken audio has an empty one."""
    source = recordings.select(id_col, audio_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py()).view(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], [id_col, "fp"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, fp array<int>")


def align_recordings(
    prints: DataFrame, queries: DataFrame, id_col: str = "id", fp_col: str = "fp", min_hits: int = 2, max_error: float = 0.15, min_overlap: int = 16
) -> DataFrame:
    """Recordings that align with a query: query_id, match_id, class_size, offset, hits, overlap, bit_error.

    Recordings of equal fingerprints are one class: match_id is its least id and
    class_size its size, so copies are compared once and not listed as pairs; a
    query finds its own class with bit_error 0. For every other class, the
    offset (class position minus query position) with the most shared integers
    counts, ties by the least error, then the least offset. Kept are those with
    at least min_hits hits and min_overlap frames of overlap, and a share of at
    most max_error of the overlap's bits that differ. Empty fingerprints match
    nothing. Repeated query ids give a row for each. No rows: no rows.
    """
    key = F.xxhash64(fp_col)
    some = prints.where(F.size(fp_col) > 0)
    classes = some.groupBy(key.alias("class"), F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("match_id"), F.count("*").alias("class_size"))
    asked = queries.where(F.size(fp_col) > 0).select(F.col(id_col).alias("query_id"), key.alias("own"), F.col(fp_col).alias("query_fp"))
    # queries of one class are looked up once
    distinct = asked.groupBy("own", "query_fp").agg(F.count("*").alias("asked"))
    left = distinct.select("own", F.posexplode("query_fp").alias("query_pos", "value"))
    right = classes.select("class", F.posexplode("fp").alias("pos", "value"))
    # an integer that a recording repeats (silence, a held tone) counts once on each side for an offset
    hits = (
        left.join(right, "value")
        .groupBy("own", "class", (F.col("pos") - F.col("query_pos")).alias("offset"))
        .agg(F.count("*").alias("hits"))
    )
    best = hits.withColumn("most", F.max("hits").over(Window.partitionBy("own", "class"))).where((F.col("hits") == F.col("most")) & (F.col("hits") >= min_hits))
    pairs = best.join(distinct.select("own", "query_fp"), "own").join(classes.select("class", "fp", "match_id", "class_size"), "class")
    source = pairs.select("own", "match_id", "class_size", "offset", "hits", "query_fp", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            overlap, error = [], []
            for offset, a, b in zip(batch.column(3).to_pylist(), batch.column(5), batch.column(6)):
                a, b = (x.values.to_numpy(zero_copy_only=False).view(np.uint32) for x in (a, b))
                a, b = a[max(0, -offset) :], b[max(0, offset) :]
                n = min(len(a), len(b))
                overlap.append(n)
                error.append(float(np.bitwise_count(a[:n] ^ b[:n]).sum()) / (32 * n) if n else 1.0)
            arrays = [*batch.columns[:5], pa.array(overlap, pa.int32()), pa.array(error, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["own", "match_id", "class_size", "offset", "hits", "overlap", "bit_error"])

    kind = prints.schema[id_col].dataType.simpleString()
    scored = source.mapInArrow(run, f"own bigint, match_id {kind}, class_size bigint, offset int, hits bigint, overlap int, bit_error double")
    first = Window.partitionBy("own", "match_id").orderBy("bit_error", "offset")
    kept = scored.where((F.col("overlap") >= min_overlap) & (F.col("bit_error") <= max_error)).withColumn("r", F.row_number().over(first)).where("r = 1")
    return asked.select("query_id", "own").join(kept, "own").select("query_id", "match_id", "class_size", "offset", "hits", "overlap", "bit_error")


def class_members(prints: DataFrame, id_col: str = "id", fp_col: str = "fp") -> DataFrame:
    """member_id, match_id and class_size of every row: the class of align_recordings it is in; of empty fingerprints, null."""
    some = prints.select(F.col(id_col).alias("member_id"), F.when(F.size(fp_col) > 0, F.xxhash64(fp_col)).alias("class"))
    heard = some.where("class is not null")
    classes = heard.groupBy("class").agg(F.min("member_id").alias("match_id"), F.count("*").alias("class_size"))
    # the few large classes are joined without a shuffle, so that none fills a task
    large = F.broadcast(classes.where(F.col("class_size") > CLASS_ROWS))
    usual = heard.join(large.select("class"), "class", "left_anti").join(classes.where(F.col("class_size") <= CLASS_ROWS), "class")
    silent = some.where("class is null").select("member_id", F.lit(None).cast(prints.schema[id_col].dataType).alias("match_id"), F.lit(None).cast("long").alias("class_size"))
    return heard.join(large, "class").drop("class").unionByName(usual.drop("class")).unionByName(silent)


def tone_wav(vector: list[float] | None, note: int = 512, rate: int = 4000) -> bytes:
    """A recording that plays a vector: for each component a tone of one of 24 half tones from 220 Hz; null: no samples."""
    values = np.nan_to_num(np.array([0.0 if x is None else x for x in vector or ()], float))
    scale = max(float(np.sqrt((values**2).mean())), 1e-12) if len(values) else 1.0
    half_tones = np.clip(np.floor(12 + 6 * values / scale), 0, 23)
    frequency = np.repeat(220.0 * 2 ** (half_tones / 12), note)
    samples = 0.6 * np.sin(2 * np.pi * np.cumsum(frequency) / rate)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes((samples * 32767).astype("<i2").tobytes())
    return out.getvalue()


def play_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id_col and audio (a WAV file) of every row, for tables that have vectors and no media."""
    source = vectors.select(id_col, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # 64 KB of audio a row
                part = batch.slice(at, 256)
                audio = pa.array([tone_wav(x) for x in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), audio], [id_col, "audio"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, audio binary")


def _prints(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return materialise(fingerprints(play_vectors(vectors, id_col, vector_col), id_col, "audio"), "fingerprints")


def audio_search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100) -> DataFrame:
    """align_recordings for the recordings of vectors; queries: every row whose id is divisible by every."""
    prints = _prints(vectors, id_col, vector_col)
    return align_recordings(prints, prints.where(F.col(id_col) % every == 0), id_col)


def audio_search_members(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100) -> DataFrame:
    """The rows of audio_search, and a row for every recording with its class: member_id, match_id, class_size; the other columns are null."""
    prints = _prints(vectors, id_col, vector_col)
    found = align_recordings(prints, prints.where(F.col(id_col) % every == 0), id_col)
    return found.unionByName(class_members(prints, id_col), allowMissingColumns=True)

"""Importance resampling towards a target's word runs, whose CRC-32s are composed from the words' own.

``crc(a + b)`` is ``crc(a)`` moved by the length of ``b`` (a linear map over GF(2)), exclusive-or ``crc(b)``. So each word's CRC is computed
once, and the run of n words is put together from that of n - 1 words; no run is ever written out.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadyframe.llm.common import append_columns, materialize, pieces, small, trim

BUCKETS = 10_000
#: Bytes scanned at once, and the longest word whose CRC is computed along with others.
STRETCH, LONG = 4 << 20, 64
POLYNOMIAL = 0xEDB88320
LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], dtype=np.uint8)
IN_WORD = np.array([c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= LOWER[c] <= 0x7A for c in range(256)])


def _one_byte() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return table


CRC = _one_byte()


def _applied(columns: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), as the images of the bits, times each vector."""
    out = np.zeros_like(vectors)
    for bit in range(32):
        out ^= np.where((vectors >> np.uint32(bit)) & np.uint32(1), columns[bit], np.uint32(0))
    return out


def _shifts(most: int = 40) -> list[np.ndarray]:
    """For each k, the map of a CRC moved by 2^k bytes, as four tables for the bytes of the CRC."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    matrix = CRC[bits & np.uint32(255)] ^ (bits >> np.uint32(8))  # moved by one zero byte
    out = []
    for _ in range(most):
        out.append(np.stack([_applied(matrix, np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)]))
        matrix = _applied(matrix, matrix)
    return out


SHIFTS = _shifts()


def combined(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRCs of texts put together, from those of their two parts and the lengths of the second parts."""
    out = first.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        on = np.flatnonzero(lengths >> k & 1)
        c, t = out[on], SHIFTS[k]
        out[on] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return out ^ second


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC of each word, one byte of all words at a time; ``data`` is in lower case."""
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, LONG + 1), kind="stable")
    at, size = starts[order], sizes[order]
    crc = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    begin = int((size > LONG).sum())
    for p in range(int(size[begin]) if begin < len(size) else 0):
        n = int(np.searchsorted(-size[begin:], -p))  # words longer than p
        c = crc[begin : begin + n]
        crc[begin : begin + n] = CRC[(c ^ data[at[begin : begin + n] + p]) & 255] ^ (c >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(begin):
        crc[k] = zlib.crc32(data[at[k] : at[k] + size[k]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, CRC, length) of each word of a batch of texts, in order. Long texts are scanned in stretches."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    rows, crcs, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    a, stop = int(offsets[0]) if len(offsets) else 0, int(offsets[-1]) if len(offsets) else 0
    while a < stop:
        b = min(a + STRETCH, stop)
        while b < stop and IN_WORD[data[b]]:  # up to the word's end
            rest = IN_WORD[data[b : b + 4096]]
            b = min(b + (int(rest.argmin()) if not rest.all() else len(rest)), stop)
        part = LOWER[data[a:b]]
        flags = np.concatenate(([False], IN_WORD[part], [False]))
        begins, ends = flags[1:-1] & ~flags[:-2], flags[1:-1] & ~flags[2:]
        cuts = offsets[(offsets > a) & (offsets < b)] - a  # texts end here even inside a run
        begins[cuts] = flags[1:-1][cuts]
        ends[cuts - 1] = flags[1:-1][cuts - 1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        rows.append(np.searchsorted(offsets, starts + a, side="right") - 1)
        crcs.append(word_crcs(part, starts, stops))
        sizes.append(stops - starts)
        a = b
    return np.concatenate(rows), np.concatenate(crcs), np.concatenate(sizes)


def runs(rows: np.ndarray, crcs: np.ndarray, sizes: np.ndarray, shortest: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, CRC) of all runs of ``shortest`` to ``longest`` words of one text, joined by one space."""
    spaced = combined(np.full(len(crcs), zlib.crc32(b" "), dtype=np.uint32), crcs, sizes) if longest > 1 else crcs
    now = crcs
    for n in range(1, longest + 1):
        if n > 1:
            now = combined(now[: len(crcs) - n + 1], spaced[n - 1 :], sizes[n - 1 :] + 1)
        if n >= shortest:
            inside = rows[: len(now)] == rows[n - 1 :]
            yield rows[: len(now)][inside], now[inside]
        if len(crcs) <= n:
            return


def bucket_counts(texts: DataFrame, shortest: int, longest: int, buckets: int) -> np.ndarray:
    """Runs a bucket over all texts (one column, null: none); each task sends one row a bucket at most."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch):
                for _, crc in runs(*words(part.column(0).fill_null("")), shortest, longest):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])
        trim()

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.mapInArrow(partial, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand log likelihood ratios of target over source for each bucket, add-one smoothed, rounded down."""
    size = len(source)
    s, t = float(source.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(seed: str, key: str | None) -> int:
    """A thousand standard Gumbel variates, rounded down, from the hash of seed and key (null: empty)."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """Add ``rank`` from 1 over the whole table: ranges of the order, counted, then the places inside each."""
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    rows = materialize(rows, "ranked").withColumn("part", F.shiftright("seq", 33))
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    parts = small(rows.groupBy("part").count().select("part", F.coalesce(before, F.lit(0)).alias("before")))
    return rows.join(parts, "part").withColumn("rank", F.col("before") + F.col("seq") - F.shiftleft("part", 33) + 1).drop("seq", "part", "before")


def reweight(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", shortest: int = 1, longest: int = 2,
    buckets: int = BUCKETS, min_words: int = 20, percent: int = 10, seed: str = "2024",
) -> DataFrame:
    """``docs`` with n_words, n_features, weight, score and rank (null: not drawn); the text goes, and columns named like added ones are replaced.

    weight: the gains of a document's runs of ``shortest`` to ``longest`` words, summed; score: weight and Gumbel noise. Of the documents with at least
    ``min_words`` words the ``percent`` in a hundred with the highest scores are drawn, ties to the smaller id (null last). Null and empty texts have no
    words; very long ones are scanned in stretches; repeated rows count each, with equal scores, and are ranked one after the other. An
    empty table of documents gives no rows; without target texts all gains come from the smoothing.
    """
    source = bucket_counts(docs.select(text_col), shortest, longest, buckets)
    gain = gains(source, bucket_counts(targets.select(target_col), shortest, longest, buckets))
    added = ("n_words", "n_features", "weight", "score")
    fields = [T.StructField(c, T.LongType()) for c in added]
    kept = [c for c in docs.columns if c not in (*added, "rank", "seq", "part", "before", "row_") or c == id_col]
    rows = docs.select(*kept, F.col(id_col).cast("string").alias("key_"))

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, object]:
            n = batch.num_rows
            found = words(batch.column(batch.schema.get_field_index(text_col)).fill_null(""))
            features, weight = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for row, crc in runs(*found, shortest, longest):
                features += np.bincount(row, minlength=n)
                weight += np.bincount(row, weights=gain[crc % np.uint32(buckets)], minlength=n).astype(np.int64)
            drawn = np.array([noise(seed, k) for k in batch.column(batch.schema.get_field_index("key_")).to_pylist()], dtype=np.int64)
            return {"n_words": np.bincount(found[0], minlength=n), "n_features": features, "weight": weight, "score": weight + drawn}

        return step

    scored = append_columns(rows, fields, make, without=(text_col, "key_")).withColumn("row_", F.monotonically_increasing_id())
    scored = materialize(scored, "scored")
    able = scored.where(F.col("n_words") >= min_words)
    most = able.count() * percent // 100
    first = ranked(able, [F.desc("score"), F.asc_nulls_last(id_col), F.asc("row_")])
    first = first.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return first.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))).drop("row_")

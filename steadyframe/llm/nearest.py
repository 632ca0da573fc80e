"""Exact top-k inner products, pruned by segment statistics from coarse to fine.

The squared distance of two vectors is at least the sum over segments of ``length * ((mean - mean')² + (deviation - deviation')²)``; with the
squared lengths, which the same statistics add up to, this bounds the inner product from above by
``length * (mean * mean' + deviation * deviation')``. So the bounds of all pairs of a block are one small matrix product a level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadyframe.llm.common import materialize, pieces, small, trim

#: Segments of a vector at each level, coarse to fine; vectors are padded with zeros to a multiple of the last.
LEVELS = (1, 4, 16, 32)
#: Vectors of a block, queries of a block, and bytes of a block's components as doubles at most (one vector at least).
ROWS, QUERIES, BYTES = 32_768, 4_096, 32 << 20
#: Queries that are compared with a block at once.
STEP = 64
PACKED = "block long, width int, ids binary, codes binary, short boolean"


def quantized(lists: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of all components, one after the other, the vectors' lengths, and which vectors have finite components only."""
    lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    values = np.asarray(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        codes = np.floor(values * scale)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(codes))))
    ends = np.cumsum(lengths)
    return codes, lengths, bad[ends] == bad[ends - lengths]


def padded(codes: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = codes
    return out


def pack(vectors: DataFrame, scale: float, rows: int, name: str) -> DataFrame:
    """(id, vector) to a written table of blocks; a block's number names its task and its place there. Vectors that are null or have a
    component that is null or not finite, and those without an id, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 24, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block():
            nonlocal made, held
            ids, codes, lengths = (np.concatenate(x) for x in zip(*held))
            width = -(-max(int(lengths.max()), 1) // LEVELS[-1]) * LEVELS[-1]
            table = padded(codes, lengths, width)
            short = bool(np.abs(table).max() < 1 << 15)
            made, held = made + 1, []
            row = [first + made - 1], [width], [ids.astype("<i8").tobytes()], [table.astype("<i2" if short else "<f8").tobytes()], [short]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=["block", "width", "ids", "codes", "short"])

        count = longest = 0
        for batch in batches:
            for part in pieces(batch):
                part = pa.table({"id": part.column(0), "v": part.column(1)}).drop_null().combine_chunks()
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024).combine_chunks()
                    lists = some.column("v").chunk(0)
                    codes, lengths, good = quantized(lists, scale)
                    ids = some.column("id").to_numpy()[good].astype(np.int64)
                    codes, lengths = codes[np.repeat(good, lengths)], lengths[good]
                    ends = np.concatenate(([0], np.cumsum(lengths)))
                    start = 0
                    while start < len(ids):  # as many as still fit into the block
                        widths = np.maximum(np.maximum.accumulate(lengths[start:]), longest)
                        fits = (count + 1 + np.arange(len(widths)) <= rows) & ((count + 1 + np.arange(len(widths))) * widths * 8 <= BYTES)
                        n = int(np.argmin(fits)) if not fits.all() else len(fits)
                        n = max(n, 0 if count else 1)
                        if n:
                            held.append((ids[start : start + n], codes[ends[start] : ends[start + n]], lengths[start : start + n]))
                            count, longest, start = count + n, int(widths[n - 1]), start + n
                        if start < len(ids):
                            yield block()
                            count = longest = 0
        if held:
            yield block()
        trim()

    return materialize(vectors.mapInArrow(run, PACKED), name)


def statistics(table: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, times the root of a segment's length: their products add up to the bound."""
    parts = table.reshape(len(table), segments, -1)
    return (np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1) * np.sqrt(parts.shape[2])).astype(np.float32)


class Block:
    """The vectors of a block, equal ones once; of each the ids that a result of ``k`` may need, ascending."""

    def __init__(self, ids: np.ndarray, table: np.ndarray, k: int) -> None:
        seen, of = np.unique(np.ascontiguousarray(table).view(f"V{table.shape[1] * 8}").ravel(), return_inverse=True)
        self.table = seen.view(np.float64).reshape(len(seen), -1)
        order = np.lexsort((ids, of))
        ids, of = ids[order], of[order]
        # a query leaves out the rows of one id: k rows of an id and 2k of a vector are enough
        ids, of = self._first(ids, of, k, [of, ids])
        self.ids, of = self._first(ids, of, 2 * k, [of])
        self.at = np.searchsorted(of, np.arange(len(seen) + 1))
        self.norms = np.sqrt((self.table**2).sum(axis=1))
        self.levels: dict[int, np.ndarray] = {}

    @staticmethod
    def _first(ids, of, most, by):
        new = np.ones(len(ids), dtype=bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in by])
        starts = np.flatnonzero(new)
        keep = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids)))) < most
        return ids[keep], of[keep]

    def widened(self, width: int) -> None:
        if width > self.table.shape[1]:
            self.table = np.pad(self.table, ((0, 0), (0, width - self.table.shape[1])))
            self.levels = {}

    def level(self, segments: int) -> np.ndarray:
        if segments not in self.levels:
            self.levels[segments] = statistics(self.table, segments)
        return self.levels[segments]

    def results(self, scores, which: np.ndarray, own: int, k: int) -> tuple[list[int], list[int]]:
        """The ids and scores of the best ``k`` rows among the vectors ``which``, without those of id ``own``."""
        if len(which) > k + 1:
            keep = scores >= np.partition(scores, len(which) - k - 1)[len(which) - k - 1]  # the own vector may be one of them
            scores, which = scores[keep], which[keep]
        sizes = self.at[which + 1] - self.at[which]
        place = np.repeat(self.at[which] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(which) else np.zeros(0, dtype=np.int64)
        ids, scores = self.ids[place.astype(np.int64)], np.repeat(scores, sizes)
        other = ids != own
        ids, scores = ids[other], scores[other]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best].tolist(), [int(x) for x in scores[best]]

    def search(self, owns: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, list[int], list[int]]]:
        """For each query its place, ids and scores. ``floors``: scores that a result has to reach."""
        self.widened(queries.shape[1])
        if queries.shape[1] < self.table.shape[1]:
            queries = np.pad(queries, ((0, 0), (0, self.table.shape[1] - queries.shape[1])))
        norms = np.sqrt((queries**2).sum(axis=1))
        top = norms.max() * self.norms.max()
        if not top < 1 << 52:  # sums of doubles would be rounded: whole numbers of any size
            rows = np.array([[int(x) for x in v] for v in self.table], dtype=object)
            for j, q in enumerate(queries):
                scores = rows @ np.array([int(x) for x in q], dtype=object)
                scores = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in scores], dtype=object)
                yield j, *self.results(scores, np.arange(len(rows)), owns[j], k)
            return
        kind = np.float32 if top < 1 << 24 else np.float64  # either way every partial sum is exact
        table, queries = self.table.astype(kind), queries.astype(kind)
        first = min(len(table), max(4 * k, len(table) // 16))  # their exact scores give each query a floor
        for a in range(0, len(queries), STEP):
            qs = queries[a : a + STEP]
            exact = table[:first] @ qs.T
            floor = floors[a : a + STEP].copy()
            for j in range(len(qs)):
                known = self.results(exact[:, j].astype(np.float64), np.arange(first), owns[a + j], k)[1]
                if len(known) == k:
                    floor[j] = max(floor[j], known[-1])
            rows = np.arange(len(table))
            alive = np.ones((len(rows), len(qs)), dtype=bool)
            for s in LEVELS:
                bound = self.level(s)[rows] @ statistics(qs, s).T
                slack = 1e-5 * self.norms[rows][:, None] * norms[a : a + STEP] + 1e-3  # single precision
                alive &= bound + slack >= floor
                any_ = alive.any(axis=1)
                rows, alive = rows[any_], alive[any_]
            for j in range(len(qs)):
                which = rows[alive[:, j]]
                scores = (table[which] @ qs[j]).astype(np.float64)
                reach = scores >= floor[j]
                yield a + j, *self.results(scores[reach], which[reach], owns[a + j], k)


def unpacked(ids: bytes, codes: bytes, width: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    table = np.frombuffer(codes, dtype="<i2" if short else "<f8").astype(np.float64).reshape(-1, width)
    return np.frombuffer(ids, dtype="<i8").astype(np.int64), table


def _meet(blocks: DataFrame, queries: DataFrame, floors: DataFrame | None, k: int) -> DataFrame:
    """Rows (uid, query_id, vec_id, score): of each query and block the best rows, if they reach the query's floor."""
    sent = queries.select("block", "width", "ids", "codes", "short")
    sent = sent.join(floors, "block", "left") if floors is not None else sent.withColumn("floors", F.lit(None).cast("array<struct<place:int,floor:long>>"))
    # blocks of queries meet all blocks: what is broadcast is a number a block, 8 bytes for some 32,768 vectors
    numbers = small(blocks.select(F.col("block").alias("meets")))
    sent = sent.crossJoin(numbers).select("meets", F.lit(1).alias("kind"), "block", "width", "ids", "codes", "short", "floors")
    mine = blocks.select(F.col("block").alias("meets"), F.lit(0).alias("kind"), "block", "width", "ids", "codes", "short", F.lit(None).cast("array<struct<place:int,floor:long>>").alias("floors"))
    dealt = mine.unionByName(sent).repartition(max(1, blocks.count()), "meets").sortWithinPartitions("meets", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: Block | None = None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(c)[r].as_py() for c, n in enumerate(batch.schema.names)}
                ids, table = unpacked(row["ids"], row["codes"], row["width"], row["short"])
                if row["kind"] == 0:
                    here = Block(ids, table, k)
                    continue
                least = np.full(len(ids), -np.inf)
                for f in row["floors"] or ():
                    least[f["place"]] = f["floor"]
                uid, query, found, score = [], [], [], []
                for j, best, scores in here.search(ids, table, least, k):
                    uid += [(row["block"] << 12) + j] * len(best)
                    query += [int(ids[j])] * len(best)
                    found += best
                    score += scores
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (uid, query, found, score)], names=["uid", "query_id", "vec_id", "score"])
        trim()

    return dealt.mapInArrow(run, "uid long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 5, id_col: str = "vec_id", vector_col: str | Column = "embedding", scale: float = 256.0, rows: int = ROWS, query_rows: int = QUERIES) -> DataFrame:
    """Each query's ``k`` rows of highest inner product of floor(``scale`` * x): query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    ``queries`` (default: ``vectors``) has the same two columns. Every row of ``queries`` is a query, repeated rows too; its candidates are all
    rows of another id, each repeated row counting. Vectors that are null, or have null or non-finite components, and rows
    without an id take no part; an empty vector scores 0; of vectors of unequal length the shorter counts as padded with zeros. Scores beyond a long
    count as the nearest long. Other columns are ignored; no vectors or no queries give no rows.

    Vectors go in blocks of ``rows``, queries in blocks of ``query_rows``, and each block of queries is sent to each block of vectors: the vectors
    are moved once, and a task holds one block. About a sixteenth of the blocks goes first; its k-th scores are floors for the rest,
    which prune there and keep what each block returns small. Equal vectors of a block are compared once.
    """
    if query_rows > 1 << 12:
        raise ValueError("query_rows is at most 4096")
    wanted = (vectors if queries is None else queries).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("v is not null and id is not null")
    wanted = wanted.repartition(max(1, -(-wanted.count() // query_rows)))
    asked = pack(wanted, scale, query_rows, "queries")
    blocks = pack(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), scale, rows, "blocks")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")

    def best(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    early = F.pmod(F.xxhash64("block"), F.lit(16)) == 0
    opening = materialize(best(_meet(blocks.where(early), asked, None, k)).drop("rank"), "opening")
    floors = opening.groupBy("uid").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
    floors = floors.groupBy(F.shiftright("uid", 12).alias("block")).agg(F.collect_list(F.struct((F.col("uid") % 4096).cast("int").alias("place"), "floor")).alias("floors"))
    rest = _meet(blocks.where(~early), asked, floors, k)
    return best(opening.unionByName(rest)).select("query_id", "rank", "vec_id", "score")

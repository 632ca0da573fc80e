"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Estimated bytes of a side that may be broadcast; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-steadyframe-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_MADE: ContextVar[list | None] = ContextVar("made", default=None)


@contextlib.contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """The tables that ``materialize`` writes inside, for ``release`` when a later table has taken their place; otherwise they stay."""
    made: list[DataFrame] = []
    before = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at a table that outlives executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


def release(table: DataFrame) -> None:
    """Delete what ``materialize`` wrote, when nothing will read it any more."""
    session = table.sparkSession
    folder = session._jvm.org.apache.hadoop.fs.Path(table._written)
    folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)


def row_bytes(kind: T.DataType) -> int:
    """About how many bytes a value takes; texts and arrays are not bounded by their type and count as short ones."""
    if isinstance(kind, T.StructType):
        return 8 + sum(row_bytes(f.dataType) for f in kind.fields)
    return 40 if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType)) else 8


def small(df: DataFrame, more: int = 0) -> DataFrame:
    """Hint a broadcast of a table that is no larger than the bound by its row count and types, and ``more`` bytes; else leave the join to a shuffle."""
    most = max(0, BROADCAST_BYTES - more) // (16 + row_bytes(df.schema))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str, salts: int = 32, size: int | None = None) -> DataFrame:
    """Join with a ``right`` of few rows a key, however many rows of ``left`` share a key: a small right side is broadcast, a larger one is
    repeated ``salts`` times and the left rows are dealt over the copies. ``size`` is the right side's bytes where they were measured."""
    hinted = small(right) if size is None else F.broadcast(right) if size <= BROADCAST_BYTES else right
    if hinted is not right:
        return left.join(hinted, on, how)
    dealt = left.withColumn("salt_", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = right.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "salt_"], how).drop("salt_")


def pair_id(h: str, g: str) -> Column:
    """Two longs as one binary of 16 bytes."""
    return F.unhex(F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(F.hex(g), 16, "0")))


def first_half(c: str) -> Column:
    return F.conv(F.hex(F.substring(c, 1, 8)), 16, -10).cast("long")


def second_half(c: str) -> Column:
    return F.conv(F.hex(F.substring(c, 9, 8)), 16, -10).cast("long")


def append_columns(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]],
    without: tuple[str, ...] = (),
) -> DataFrame:
    """Add Arrow-computed columns. ``make`` runs once a task and gives the function for each batch.

    Input columns named like an added one are replaced; those of ``without`` are read only.
    """
    names = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in names and f.name not in without]
    schema = T.StructType(kept + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in pieces(batch):
                added = step(part)
                columns = [part.column(f.name).cast(arrow.field(f.name).type) for f in kept]
                columns += [x if isinstance(x := added[n], pa.Array) else pa.array(x, type=arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give memory that a finished task no longer needs back to the system, as idle Python workers stay alive."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a part holds about ``most`` bytes, one row at least."""
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


class Forest:
    """Union-find over arbitrary hashable ids; the smaller id becomes the root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


# --- keys of an index travel as blobs of sorted numbers, one for each range of keys: 5 bytes a key, 8 bytes an id

SENT_KEYS = "range int, several boolean, keys binary, ids binary"


def sent_keys(keys: np.ndarray, ids: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Keys of a task's distinct items by range. What shares a key here already is sent as ``several``, and one of it also as a single."""
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(keys)))
    rows = []
    for several, which in ((False, new), (True, np.repeat(size > 1, size))):
        k, i = keys[which], ids[which]
        of = (k >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        cuts = np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64)).tolist()
        low = np.ascontiguousarray(k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        rows += [(r, several, low[a:b].tobytes(), i[a:b].tobytes()) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate(kinds)], names=["range", "several", "keys", "ids"])


def _unpacked(r: int, keys: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(keys) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(keys, dtype=np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<i8") | (r << 40), np.frombuffer(ids, dtype=np.int64)


def _met(batches):
    """Blobs sorted by range to rows (key, id) of keys that two ids or more have. Only singles, one a key and task's flush, are held."""

    def rows(keys, ids):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], names=["key", "id"])

    def shared(held):
        keys, ids = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(new)
        differ = np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts)  # one id may come from several tasks
        which = np.repeat(differ, np.diff(np.append(starts, len(keys))))
        return rows(keys[which], ids[which])

    at, held = None, []
    for batch in batches:
        for r, several, keys, ids in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if r != at and held:
                yield shared(held)
                held = []
            at = r
            if several:
                yield rows(*_unpacked(r, keys, ids))
            else:
                held.append(_unpacked(r, keys, ids))
    if held:
        yield shared(held)
    trim()


def shared_keys(sent: DataFrame, ranges: int) -> DataFrame:
    """Rows of ``sent_keys`` to distinct rows (key long, id long): the keys that two ids or more have, with these ids."""
    return sent.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_met, "key long, id long").distinct()


def reread(table: DataFrame, session: SparkSession) -> DataFrame:
    """A table that ``materialize`` wrote, read in another session."""
    out = session.read.schema(table.schema).parquet(table._written)
    out._written = table._written
    return out


def session_for(spark: SparkSession, batch: int | None) -> SparkSession:
    """A session with the settings of ``spark`` whose jobs send ``batch`` rows at most to Python at once, for wide rows; without ``batch``, ``spark`` itself."""
    if not batch:
        return spark
    own = spark.newSession()
    for r in spark.sql("SET").collect():
        if r["key"].startswith("spark.sql.") and spark.conf.isModifiable(r["key"]):
            own.conf.set(r["key"], r["value"])
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    return own


def linked(met: DataFrame, block: int, dress: Callable[[DataFrame], DataFrame], linker: Callable[[], Callable], kind: str, batch: int | None = None) -> DataFrame:
    """Edges (a, b) between ids that meet under a key and are similar: all of each component that the groups' links make.

    ``met`` has distinct rows (key long, id long) of keys with two ids or more; of keys with the same ids one is looked at. ``dress`` adds
    to rows with ``id`` what is compared and ``uid``, the id of the edges (of SQL type ``kind``); ``linker()`` gives, once for each deal, a
    function of a frame's columns and a group's first and last place in them to the edges, as two lists of row numbers in the group.

    A group of more than ``block`` ids is dealt into blocks, each with the group's smallest id besides. What a block
    joins to that id is one component already; only the ids that are left meet the other blocks, in groups of two
    blocks. So a group of many near copies costs time in proportion to its size, and every pair still meets
    or is joined. No task holds more than about two blocks. ``batch`` bounds the rows that
    are sent to Python at once, in a session apart, so that the caller's keeps its settings. A key however common is dealt over tasks when it is looked up.
    """
    sums = [F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(7, id))").alias("y")]
    keys = met.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), *sums).where("n > 1")
    once = keys.groupBy("n", "lo", "hi", "x", "y").agg(F.min("key").alias("key")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    once = materialize(once.select("key", "lo", "n", "blocks"), "keys")
    rows = spread_join(met, once, ["key"], "inner").withColumn("i", F.expr("cast(pmod(xxhash64(3, id), blocks) as int)"))
    rows = materialize(rows.select("key", "id", "lo", "n", "blocks", "i"), "rows")
    spark = met.sparkSession
    apart = session_for(spark, batch)
    rows = reread(rows, apart)
    wide = rows.where("blocks > 1")
    # groups of few ids that share the smallest one often overlap: dealt together, a line is prepared once for all
    deal = F.when(F.col("n") <= 64, F.col("lo")).otherwise(F.xxhash64("key", "i"))
    lone = wide.where("id = lo").withColumn("i", F.explode(F.expr("array_remove(sequence(0, blocks - 1), i)")))
    first = rows.unionByName(lone).withColumn("j", F.col("i")).select(deal.alias("deal"), "key", "i", "j", "id", (F.col("blocks") > 1).alias("wide"), (F.col("id") == F.col("lo")).alias("lowest"))
    found = reread(materialize(_link_groups(dress(first), linker, kind), "links"), spark)
    left = found.where("key is not null").select("key", "id").distinct()
    edges = found.where("key is null").select("a", "b")
    if not left.isEmpty():
        left = reread(materialize(left, "left"), apart)
        known = wide.join(left.withColumn("loose", F.lit(True)), ["key", "id"], "left").withColumn("loose", F.coalesce("loose", F.lit(False)))
        loose = known.where("loose").select("key", F.col("i").alias("k")).distinct()  # blocks with ids that are left
        pairs = known.join(loose, "key").where("i <> k")
        # block i meets each block k with ids that are left; of block k's rows those that are left come along
        mine = pairs.select("key", F.col("i"), F.col("k").alias("j"), "id", F.lit(False).alias("wide"), F.lit(False).alias("lowest"))
        theirs = known.where("loose").withColumn("o", F.explode(F.expr("array_remove(sequence(0, blocks - 1), i)"))).select("key", F.col("o").alias("i"), F.col("i").alias("j"), "id", F.lit(False).alias("wide"), F.lit(False).alias("lowest"))
        second = mine.unionByName(theirs).select(F.xxhash64("key", "i", "j").alias("deal"), "key", "i", "j", "id", "wide", "lowest")
        more = reread(materialize(_link_groups(dress(second), linker, kind), "links"), spark)
        edges = edges.unionByName(more.where("key is null").select("a", "b"))
    return edges.distinct()


def _link_groups(dealt: DataFrame, linker: Callable[[], Callable], kind: str) -> DataFrame:
    """Edges (a, b) of each group (deal, key, i, j), and rows (key, id) of the ids of wide groups that are not joined to the lowest."""
    dealt = dealt.repartition("deal").sortWithinPartitions("deal", "key", "i", "j", "id")

    def run(frames):
        import pandas as pd

        link, deal = None, None
        for f in sorted_groups(frames, ["deal", "key", "i", "j"]):
            cuts = group_starts(f, ["deal", "key", "i", "j"]).tolist()
            columns = {c: f[c].to_numpy() for c in f.columns}
            deals, keys, ids, uids, wide, lowest = (columns[c] for c in ("deal", "key", "id", "uid", "wide", "lowest"))
            a, b, loose = [], [], []
            for s, e in zip(cuts, cuts[1:]):
                if deals[s] != deal:
                    link, deal = linker(), deals[s]
                x, y = link(columns, s, e)
                a += [uids[s + k] for k in x]
                b += [uids[s + k] for k in y]
                if wide[s]:
                    forest = Forest()
                    for p, q in zip(x, y):
                        forest.union(p, q)
                    heads = {forest.find(k) for k in np.flatnonzero(lowest[s:e]).tolist()}
                    loose += [s + k for k in range(e - s) if forest.find(k) not in heads]
            none = [[None] * len(x) for x in (loose, a)]
            edge = "Int64" if kind == "long" else object
            yield pd.DataFrame({"a": pd.array(a + none[0], dtype=edge), "b": pd.array(b + none[0], dtype=edge), "key": pd.array(none[1] + keys[loose].tolist(), dtype="Int64"), "id": pd.array(none[1] + ids[loose].tolist(), dtype="Int64")})
        trim()

    return dealt.mapInPandas(run, f"a {kind}, b {kind}, key long, id long")


def sorted_groups(frames: Iterator, keys: list[str]) -> Iterator:
    """Cut pandas frames that arrive sorted by ``keys`` at the ends of groups; each frame given has whole groups only."""
    import pandas as pd

    held = None
    for frame in frames:
        if not len(frame):
            continue
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        last = held[keys].iloc[-1]
        open_ = (held[keys] == last).all(axis=1).to_numpy()
        cut = int(open_.argmax())
        if cut:
            yield held.iloc[:cut].reset_index(drop=True)
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def group_starts(frame, keys: list[str]) -> np.ndarray:
    """Where the groups of a sorted frame begin, and its length at the end."""
    new = np.zeros(len(frame), dtype=bool)
    new[:1] = True
    for k in keys:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(frame))


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of ids (longs or binaries) to (id, root): root is the smallest id reachable. Ids without an edge don't appear.

    Each task first reduces its edges to a forest; large-star and small-star rounds follow, each
    ending in a written table, until nothing changes. A round's table is deleted when the next one is written.
    """
    kind = edges.schema["a"].dataType
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.int64()
    schema = f"a {kind.simpleString().replace('bigint', 'long')}, b {kind.simpleString().replace('bigint', 'long')}"

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest()
        made = 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f.union(a, b)
            made += batch.num_rows
            if made > 2_000_000:  # bounded memory: give what is known, begin anew
                yield star(f)
                f, made = Forest(), 0
        yield star(f)
        f = None
        trim()

    def star(f: Forest) -> pa.RecordBatch:
        pairs = [(x, r) for x in f.up if (r := f.find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], arrow), pa.array([p[1] for p in pairs], arrow)], names=["a", "b"])

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first()
        return tuple(r)

    now = materialize(edges.select("a", "b").where("a <> b").mapInArrow(forest, schema).distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tight = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        before, now = now, materialize(tight, "edges")
        last, seen = seen, mark(now)
        release(before)
        if last == seen:
            break
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("id"), "root").distinct())

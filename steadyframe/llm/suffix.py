"""Removal of long strings that an earlier document has: sparse suffix arrays per shard, merged across shards.

A shard holds whole documents, about ``SHARD`` bytes of them. Windows of 50 bytes fall into runs that share their least
hashed 16-byte string (the anchor), which depends on the window alone, so equal windows have equal anchors
wherever they stand. Per shard the runs' first suffixes are sorted by refining groups, and neighbours
with a common prefix as long as the run are one context. The refinement is that of Larsson and Sadakane in that only groups still unsorted are
sorted again; it goes by successive eight-byte words of the text and not by doubled ranks, because a sparse array has no rank
for the place where a suffix goes on. Shards send their contexts, sorted
by anchor, to the task of the anchor's range, which sorts them together by (anchor, hash), bounds equal anchors by binary search, and answers with each context's smallest
document id. Only anchors that meet in different contexts go to a second merge, which gets these contexts' bytes and makes the single windows
itself; of equal contexts only the shards with the smallest id send theirs, as all other documents lose them whole. Very common passages are one
context a shard, however often they occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyframe.llm.common import materialize

SHARD = 2 << 20  # bytes of text; one longer document is a shard of its own
#: Longer anchors meet less by chance, but make more contexts. On 0.51 GB: 16 bytes, 43.8 M contexts, and 149 M windows whose anchor others have; 20 bytes,
#: 49.2 M and 85 M; 24 bytes, 56.1 M and 70 M.
ANCHOR = 20
LONGEST_RUN = 64
ENTRIES = 500_000  # merged at a time
BROADCAST_BYTES = 32 << 20
NONE = np.iinfo(np.int64).max  # stands for a null id: no document is larger
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(1).integers(1 << 40, 1 << 63, 256, dtype=np.uint64) | U(1)
SHARD_SCHEMA = "shard long, ids array<long>, sizes array<long>, data binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if size < width else v


@dataclass
class Hashed:
    """Sums that give the hash of any substring: (sums[r] - sums[l]) * inverse[l]."""

    sums: np.ndarray
    inverse: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray) -> Hashed:
        n = len(raw)
        power, inverse = np.full(n + 1, BASE), np.full(n + 1, INVERSE)
        power[0] = inverse[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(inverse, out=inverse)
        sums = np.zeros(n + 1, U)
        np.cumsum(BYTE_VALUES[raw] * power[:n], out=sums[1:])
        return cls(sums, inverse)

    def at(self, lo, hi) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.inverse[lo]

    def fixed(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:-width]) * self.inverse[:n])


def suffix_order(raw: bytes, at: np.ndarray, length: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by their first ``length`` bytes, and the group of equal ones of each place in it.

    Group refinement: after a sort by the first eight bytes only groups that are still unsorted are sorted
    again, by the next eight (a sparse array has no ranks that could be doubled); within the first ``depth`` bytes all suffixes are in plain order, then equal lengths
    stand together.
    """
    word = np.ndarray(shape=(max(1, len(raw) - 7),), dtype=">u8", buffer=raw, strides=(1,))
    order = np.arange(len(at))
    group = np.zeros(len(at), dtype=np.int64)
    steps: list[int | None] = [*range(0, depth - 7, 8), depth - 8, None, *range(depth, depth + LONGEST_RUN, 8)]
    for step in steps:
        size = np.bincount(group, minlength=len(at))
        idx = np.flatnonzero(size[group] > 1)
        if not len(idx):
            break
        own, g = order[idx], group[idx]
        key = length[own].astype(U) if step is None else word[at[own] + np.minimum(step, length[own] - 8)].astype(U)
        sub = np.lexsort((key, g))
        own, key = own[sub], key[sub]
        new = np.ones(len(idx), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        order[idx] = own
        group[idx] = idx[np.maximum.accumulate(np.where(new, np.arange(len(idx)), 0))]
    return order, group


@dataclass
class Contexts:
    """A shard's windows by run, and its distinct contexts sorted by (anchor, hash)."""

    raw: bytes
    ends: np.ndarray  # of documents
    ids: np.ndarray
    hashed: Hashed
    lo: np.ndarray  # first window of each run
    count: np.ndarray  # windows of each run
    doc: np.ndarray  # document number of each run
    of: np.ndarray  # context number of each run
    anchor: np.ndarray  # of each context
    hash: np.ndarray
    least: np.ndarray  # smallest id among the context's runs here
    first: np.ndarray  # a run of it


def contexts(ids: list, sizes: np.ndarray, raw: bytes, window: int) -> Contexts | None:
    buf = np.frombuffer(raw, dtype=np.uint8)
    n, ends = len(buf), np.cumsum(sizes)
    keys = np.array([NONE if i is None else i for i in ids], dtype=np.int64)
    if n < window:
        return None
    h = Hashed.of(buf)
    wide = min(ANCHOR, window - 8)
    least = sliding_min(h.fixed(wide), window - wide + 1)[: n - window + 1]
    doc = np.repeat(np.arange(len(sizes)), sizes)[: n - window + 1]
    valid = np.arange(n - window + 1) + window <= ends[doc]
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    along = np.arange(len(least)) - np.repeat(starts, np.diff(np.append(starts, len(least))))
    new |= along % LONGEST_RUN == 0
    stop = np.ones(len(least), dtype=bool)
    stop[:-1] = new[1:] | ~valid[1:]
    lo, hi = np.flatnonzero(new & valid), np.flatnonzero(stop & valid)
    if not len(lo):
        return None
    length = hi - lo + window
    order, group = suffix_order(raw, lo, length, window)
    # one number for each distinct context, then numbers in the order of (anchor, hash)
    _, of_place = np.unique(group, return_inverse=True)
    of = np.empty(len(lo), dtype=np.int64)
    of[order] = of_place
    first = np.empty(of_place.max() + 1, dtype=np.int64)
    first[of] = np.arange(len(lo))
    anchor = mix(least[lo[first]] + U(1))
    hashes = mix(h.at(lo[first], hi[first] + window) + length[first].astype(U))
    least_id = np.full(len(first), NONE)
    np.minimum.at(least_id, of, keys[doc[lo]])
    rank = np.lexsort((hashes, anchor))
    place = np.empty_like(rank)
    place[rank] = np.arange(len(rank))
    return Contexts(raw, ends, keys, h, lo, hi - lo + 1, doc[lo], place[of], anchor[rank], hashes[rank], least_id[rank], first[rank])


def windows_of(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``count`` places in a row from each of ``begin``, and the number in ``begin`` of each."""
    number = np.repeat(np.arange(len(begin)), count)
    before = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
    return begin[number] + np.arange(len(number)) - before[number], number


# --- what goes between shards and merging tasks: sorted (anchor, hash, least id): 40 bits of the anchor within a range, all 64 of the hash


def five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unfive(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def sent(shard: int, anchor: np.ndarray, least: np.ndarray, ranges: int, more: Callable[[int, int], bytes]) -> pa.RecordBatch:
    """Rows (range, shard, n, keys, ids), one for each range of anchors; ``more`` gives what follows the anchors in the keys of entries a to b."""
    pack = zstandard.ZstdCompressor(level=1).compress
    bounds = np.searchsorted(anchor, [U((r << 64) // ranges) for r in range(1, ranges)]) if ranges > 1 else np.zeros(0, dtype=np.int64)
    cuts = [0, *bounds.tolist(), len(anchor)]
    rows = [(r, shard, b - a, five(anchor[a:b] >> U(16)) + more(a, b), pack(least[a:b].tobytes())) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=["range", "shard", "n", "keys", "ids"])


def sent_texts(shard: int, c: Contexts, chosen: np.ndarray, window: int, ranges: int) -> pa.RecordBatch:
    """As ``sent``, with the bytes of the chosen contexts: how many windows each has, then their bytes, compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    buf = np.frombuffer(c.raw, dtype=np.uint8)
    begin, count = c.lo[c.first[chosen]], c.count[c.first[chosen]]
    return sent(shard, c.anchor[chosen], c.least[chosen], ranges, lambda a, b: count[a:b].astype(np.uint8).tobytes() + pack(buf[windows_of(begin[a:b], count[a:b] + window - 1)[0]].tobytes()))


SENT = "range int, shard long, n long, keys binary, ids binary"
ANSWER = "shard long, range int, flags binary, ids binary"


def merged(rows: Iterator[pa.RecordBatch], answers: Callable[[list[tuple]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers of each range to its rows of all shards."""
    held: list[tuple] = []
    for batch in rows:
        for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if held and row[0] != held[0][0]:
                yield answers(held)
                held = []
            held.append(row)
    if held:
        yield answers(held)


def answers(rows: list[tuple]) -> pa.RecordBatch:
    """The smallest id of each (anchor, hash) of a range over all shards, and whether the anchor has others of other documents; anchors are taken in parts of about ``ENTRIES`` entries, so that many entries cost time, not memory."""
    pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    anchors = lambda r: unfive(r[3][: 5 * r[2]])
    parts = max(1, -(-sum(r[2] for r in rows) // ENTRIES))
    flags = [np.zeros(r[2], dtype=np.uint8) for r in rows]
    lower = [np.zeros(r[2], dtype=np.int64) for r in rows]
    for part in range(parts):
        own = [np.flatnonzero(anchors(r) % U(parts) == U(part)) for r in rows]
        anchor = np.concatenate([anchors(r)[i] for r, i in zip(rows, own)])
        if not len(anchor):
            continue
        hashes = np.concatenate([np.frombuffer(r[3][5 * r[2] :], dtype="<u8")[i] for r, i in zip(rows, own)])
        ids = np.concatenate([np.frombuffer(unpack(r[4]), dtype=np.int64)[i] for r, i in zip(rows, own)])
        least, several = merge(anchor, hashes, ids)
        at = 0
        for k, i in enumerate(own):
            end = at + len(i)
            flags[k][i] = (least[at:end] < ids[at:end]) | several[at:end].astype(np.uint8) << 1
            lower[k][i] = least[at:end]
            at = end
    out = [(r[1], r[0], pack(f.tobytes()), pack(v[f & 1 > 0].tobytes())) for r, f, v in zip(rows, flags, lower)]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["shard", "range", "flags", "ids"])


def merge(anchor: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry: the smallest id of equal ones, and whether its anchor has other entries of other ids."""
    rank = np.lexsort((hashes, anchor))
    a, h, d = anchor[rank], hashes[rank], ids[rank]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
    least = np.minimum.reduceat(d, np.flatnonzero(new))
    distinct = a[new]
    low, high = np.searchsorted(distinct, distinct, "left"), np.searchsorted(distinct, distinct, "right")
    group = np.flatnonzero(low == np.arange(len(distinct)))
    floor, ceiling = np.minimum.reduceat(least, group), np.maximum.reduceat(least, group)
    which = np.searchsorted(group, low)
    several = (high - low > 1) & (floor[which] < ceiling[which])
    number = np.empty(len(rank), dtype=np.int64)
    number[rank] = np.cumsum(new) - 1
    return least[number], several[number]


def window_answers(rows: list[tuple], window: int) -> pa.RecordBatch:
    """Of each window of a range's contexts: whether one equal to it is in a context of a smaller id. Anchors are taken in order, about ``ENTRIES`` windows at a time."""
    pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    anchor = np.concatenate([unfive(r[3][: 5 * r[2]]) for r in rows])
    count = np.concatenate([np.frombuffer(r[3], dtype=np.uint8, count=r[2], offset=5 * r[2]) for r in rows]).astype(np.int64)
    ids = np.concatenate([np.frombuffer(unpack(r[4]), dtype=np.int64) for r in rows])
    text = np.frombuffer(b"".join(unpack(r[3][6 * r[2] :]) for r in rows), dtype=np.uint8)
    ends = np.cumsum(count)
    begin, place = np.cumsum(count + window - 1) - count - window + 1, ends - count
    lower = np.zeros(int(ends[-1]), dtype=np.uint8)
    order = np.argsort(anchor, kind="stable")
    sizes, turn = np.cumsum(count[order]), np.flatnonzero(np.diff(anchor[order])) + 1
    at = 0
    while at < len(order):
        stop = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + ENTRIES, "right"))
        k = int(np.searchsorted(turn, stop, "right"))
        end = int(turn[k - 1]) if k and turn[k - 1] > at else int(turn[k]) if k < len(turn) else len(order)  # an anchor's contexts stay together
        end = len(order) if stop >= len(order) else end
        own, at = order[at:end], end
        part, _ = windows_of(begin[own], count[own] + window - 1)
        hashed = Hashed.of(text[part])
        starts, number = windows_of(np.cumsum(count[own] + window - 1) - count[own] - window + 1, count[own])
        a, h, d = anchor[own][number], hashed.at(starts, starts + window), ids[own][number]
        rank = np.lexsort((h, a))
        new = np.ones(len(rank), dtype=bool)
        new[1:] = (a[rank[1:]] != a[rank[:-1]]) | (h[rank[1:]] != h[rank[:-1]])
        least = np.empty(len(rank), dtype=np.int64)
        least[rank] = np.minimum.reduceat(d[rank], np.flatnonzero(new))[np.cumsum(new) - 1]
        lower[windows_of(place[own], count[own])[0]] = least < d
    cuts = np.cumsum([0] + [r[2] for r in rows])
    bounds = np.concatenate(([0], ends))[cuts]
    out = [(r[1], r[0], pack(lower[a:b].tobytes()), b"") for r, a, b in zip(rows, bounds, bounds[1:])]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["shard", "range", "flags", "ids"])


def read_flags(found: list | None) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    return np.frombuffer(b"".join(unpack(r["flags"]) for r in sorted(found or [], key=lambda r: r["range"])), dtype=np.uint8)


def read_answers(found: list | None, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's own sorted list of smallest ids to those over all shards, and which contexts go to the second merge: those whose
    anchor has several entries, unless another shard has the context with a smaller id and so sends it."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = sorted(found or [], key=lambda r: r["range"])
    flags = read_flags(rows)
    if len(flags) != len(least):
        raise ValueError("a shard's answers don't fit its list")
    out = least.copy()
    out[flags & 1 > 0] = np.frombuffer(b"".join(unpack(r["ids"]) for r in rows), dtype=np.int64)
    return out, flags == 2


def shards(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole documents in rows of about ``SHARD`` bytes, in a written table so that every later pass sees the same shards."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([pack(b"".join(texts))], pa.binary())], names=["shard", "ids", "sizes", "data"])

        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if texts and size + len(raw) > SHARD:
                    yield row()
                    number += 1
                    ids, texts, size = [], [], 0
                ids.append(id_.as_py())
                texts.append(raw)
                size += len(raw)
        if texts:
            yield row()

    return materialize(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SHARD_SCHEMA), "shards")


def _each(batches, window: int):
    """Rows with their contexts."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(j)[k].as_py() for j, name in enumerate(batch.schema.names)}
            raw, sizes = unpack(row["data"]) if sum(row["sizes"]) else b"", np.array(row["sizes"], dtype=np.int64)
            yield row, raw, sizes, contexts(row["ids"], sizes, raw, window)


def _exchange(sent_rows: DataFrame, ranges: int, answers: Callable[[list[tuple]], pa.RecordBatch]) -> DataFrame:
    """To the merging tasks, and each shard's answers back as one row."""
    answers_ = sent_rows.repartition(ranges, "range").sortWithinPartitions("range", "shard").mapInArrow(lambda rows: merged(rows, answers), ANSWER)
    return materialize(answers_.groupBy("shard").agg(F.collect_list(F.struct("range", "flags", "ids")).alias("found")), "answers")


def _with(shards_: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Shards with their answers: broadcast while they are few bytes, else by a shuffle of both."""
    size = found.agg(F.coalesce(F.sum(F.expr("aggregate(found, 0L, (a, x) -> a + octet_length(x.flags) + octet_length(x.ids))")), F.lit(0))).first()[0]
    found = found.withColumnRenamed("found", name)
    return shards_.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "shard", "left")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256.

    Bytes go that are covered by a string of ``window`` bytes that also starts in a document with a smaller id, judged on the
    input. Null texts are empty; null ids count as larger than all others and remove nothing from each other, nor do equal
    ids. Texts shorter than the window are kept. Equality of strings between shards is that of 64 bits of the string's hash within those of one anchor (40 bits more); a shard's own
    are compared byte by byte.
    """
    if window < 24:
        raise ValueError("windows must be longer than the anchors")
    table = shards(docs, id_col, text_col)
    total = table.agg(F.coalesce(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")), F.lit(0))).first()[0]
    ranges = max(1, -(-total // (30 * ENTRIES)))  # some 18 bytes of text a context: about two parts each

    def send_contexts(batches):
        for row, _, _, c in _each(batches, window):
            if c:
                yield sent(row["shard"], c.anchor, c.least, ranges, lambda a, b: c.hash[a:b].astype("<u8").tobytes())

    one = _exchange(table.mapInArrow(send_contexts, SENT), ranges, answers)
    known = _with(table, one, "one")

    def send_windows(batches):
        for row, _, _, c in _each(batches, window):
            if c:
                c.least, several = read_answers(row["one"], c.least)
                if several.any():
                    yield sent_texts(row["shard"], c, np.flatnonzero(several), window, ranges)

    two = _exchange(known.mapInArrow(send_windows, SENT), ranges, lambda rows: window_answers(rows, window))

    def finish(batches):
        for row, raw, sizes, c in _each(batches, window):
            gone = np.zeros(len(raw) + 1, dtype=np.int32)
            if c:
                c.least, several = read_answers(row["one"], c.least)
                mine = c.ids[c.doc]
                runs = np.flatnonzero(c.least[c.of] < mine)
                np.add.at(gone, c.lo[runs], 1)
                np.add.at(gone, c.lo[runs] + c.count[runs] + window - 1, -1)
                if several.any():
                    hit, count = read_flags(row["two"]), c.count[c.first]
                    begin = np.cumsum(np.where(several, count, 0)) - count
                    if len(hit) != int(count[several].sum()):
                        raise ValueError("a shard's answers don't fit its windows")
                    # the runs of the context's own document: all others are gone as a whole
                    runs = np.flatnonzero(several[c.of] & (c.least[c.of] == mine))
                    at = c.of[runs]
                    places, number = windows_of(c.lo[runs], count[at])
                    places = places[hit[windows_of(begin[at], count[at])[0]] > 0]
                    np.add.at(gone, places, 1)
                    np.add.at(gone, places + window, -1)
            yield _kept(row["ids"], raw, sizes, np.cumsum(gone[:-1]) > 0)

    both = _with(known, two, "two")
    return both.mapInArrow(finish, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def _kept(ids: list, raw: bytes, sizes: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    buf, rows, a = np.frombuffer(raw, dtype=np.uint8), [], 0
    for id_, n in zip(ids, sizes.tolist()):
        mask = gone[a : a + n]
        removed = int(mask.sum())
        kept = raw[a : a + n] if not removed else buf[a : a + n][~mask].tobytes()
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if removed else 0
        rows.append((id_, n, removed, spans, kept, hashlib.sha256(kept).hexdigest()))
        a += n
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

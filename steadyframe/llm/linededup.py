"""Fuzzy line deduplication: MinHash bands, exact Jaccard verification, union-find over lines."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyframe.llm.common import SENT_KEYS, Forest, connected_components, first_half, linked, materialize, pair_id, second_half, sent_keys, shared_keys, small, trim

SEED = 42  # of XXH64, as Spark's xxhash64 has it
PAD = np.zeros(8, dtype=np.uint8)


def shingle_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """32-bit hashes of the windows of ``width`` bytes of a buffer (the whole, if it is shorter)."""
    n = max(1, len(raw) - width + 1)
    power = np.uint32(0x01000193)
    h = np.zeros(n, dtype=np.uint32)
    for k in range(min(width, len(raw))):
        h *= power
        h += raw[k : k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    h ^= h >> np.uint32(15)
    return h


def band_keys(lines: list[bytes], width: int, bands: int, rows: int) -> np.ndarray:
    """MinHash band keys, lines x bands. Lines must not be empty; one shorter than a shingle is a shingle itself."""
    padded = [x if len(x) >= width else x + b"\x00" * (width - len(x)) for x in lines]
    raw = np.frombuffer(b"".join(padded), dtype=np.uint8)
    sizes = np.array([len(x) for x in padded], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    h = shingle_hashes(raw, width)
    # windows across two lines take the value of the line's first window, which changes no minimum
    ends = begin + sizes
    for k in range(1, width):
        at = ends - k
        ok = at < len(h)
        h[at[ok]] = h[begin[ok]]
    rng = np.random.default_rng(11)
    mul = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    x = np.empty_like(h)
    out = np.empty((len(lines), bands), dtype=np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    for b in range(bands):
        key = np.full(len(lines), b + 1, dtype=np.uint64)
        for r in range(rows):
            np.multiply(h, mul[b * rows + r], out=x)
            key ^= np.minimum.reduceat(x, begin)
            key *= mix
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out


def shingles(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct windows of ``width`` <= 8 bytes as numbers, exactly; a shorter line is one window, padded by zeros."""
    n = max(1, len(raw) - width + 1)
    # eight bytes from each place, read where they lie, less those beyond the window
    out = np.ndarray(n, dtype="<u8", buffer=raw + bytes(8), strides=(1,)) & np.uint64((1 << 8 * width) - 1)
    out.sort()
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def _lines(docs: DataFrame, text_col: str, *more: str) -> DataFrame:
    """Rows of each line that has other than blanks: ``more``, pos, line and the two halves h and g of its 128-bit hash."""
    cut = F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line")
    return docs.select(*more, cut).where(F.trim("line") != "").withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(7), "line"))


ENTRIES = 1_000_000  # band keys in a range, about
FLUSH = 40_000  # lines signed before their keys are sent


def band_members(docs: DataFrame, text_col: str, n_lines: int, width: int, bands: int, rows: int) -> DataFrame:
    """Distinct rows (key, id): the band keys that two distinct lines or more have, with the hashes of these lines."""
    ranges = max(1, -(-n_lines * bands // ENTRIES))

    def sign(batches):
        seen: set[int] = set()
        lines, hashes, size, keys, ids = [], [], 0, [], []
        for batch in batches:
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if not line.strip(" "):
                        continue
                    raw = line.encode("utf-8", "surrogatepass")
                    h = xxhash.xxh64_intdigest(raw, SEED)
                    if h in seen:
                        continue
                    seen.add(h)
                    lines.append(raw)
                    hashes.append(h)
                    size += len(raw)
                    if size > 256 << 10:
                        keys.append(band_keys(lines, width, bands, rows))
                        ids += hashes
                        lines, hashes, size = [], [], 0
                        if len(ids) >= FLUSH:
                            yield sent_keys(np.concatenate(keys).ravel(), np.repeat(np.array(ids, dtype=np.uint64).view(np.int64), bands), ranges)
                            keys, ids = [], []
                            seen.clear()
        if lines:
            keys.append(band_keys(lines, width, bands, rows))
            ids += hashes
        if ids:
            yield sent_keys(np.concatenate(keys).ravel(), np.repeat(np.array(ids, dtype=np.uint64).view(np.int64), bands), ranges)
        seen.clear()
        trim()

    sent = docs.select(text_col).mapInArrow(sign, SENT_KEYS)
    return materialize(shared_keys(sent, ranges), "met")


def near_edges(docs: DataFrame, text_col: str, n_lines: int, threshold: float, width: int, bands: int, rows: int, block: int) -> DataFrame:
    """Edges (a, b) between the 16-byte hashes of distinct lines whose byte shingles' Jaccard similarity reaches ``threshold``."""
    met = band_members(docs, text_col, n_lines, width, bands, rows)
    wanted = materialize(met.select("id").distinct(), "wanted")
    texts = _lines(docs, text_col).join(small(wanted), F.col("h") == F.col("id"), "left_semi").groupBy("h", "g").agg(F.first("line").alias("line"))
    texts = materialize(texts.select("h", "line", pair_id("h", "g").alias("uid")), "texts")

    def dress(groups):
        return groups.join(texts, F.col("id") == F.col("h")).drop("h")

    return linked(met, block, dress, lambda: Verified(threshold, width).links, "binary")


class Verified:
    """Exact similarity of the lines of groups that may overlap: what one group joined, another need not compare again."""

    def __init__(self, threshold: float, width: int) -> None:
        self.threshold, self.width = threshold, width
        self.forest, self.sets = Forest(), {}

    def prepare(self, line: str) -> np.ndarray:
        return shingles(line.encode("utf-8", "surrogatepass"), self.width)

    def links(self, columns: dict[str, np.ndarray], s: int, e: int) -> tuple[list[int], list[int]]:
        """Row numbers of pairs that join what is similar, each component by a spanning tree; components known from other groups by one line each."""
        ids, lines = columns["uid"][s:e], columns["line"][s:e]
        heads = [self.forest.find(x) for x in ids]
        parts: dict[bytes, list[int]] = {}
        for k, head in enumerate(heads):
            parts.setdefault(head, []).append(k)
        a: list[int] = []
        b: list[int] = []
        for mine in parts.values():  # the group's own links, which need not be in another group
            a += mine[:1] * (len(mine) - 1)
            b += mine[1:]
        if len(parts) > 1:
            sets = []
            for x, line in zip(ids, lines):
                if (own := self.sets.get(x)) is None:
                    own = self.sets[x] = self.prepare(line)
                sets.append(own)
            for p, q in (pairwise if len(sets) <= 8 else spread)(sets, list(parts.values()), self.threshold):
                a.append(p)
                b.append(q)
                self.forest.union(ids[p], ids[q])
        return a, b


def pairwise(sets: list[np.ndarray], parts: list[list[int]], threshold: float) -> list[tuple[int, int]]:
    """What ``spread`` gives, for a few sets: each pair of parts that are not joined yet."""
    forest, links = Forest(), []
    for n, mine in enumerate(parts):
        for m, other in enumerate(parts[:n]):
            if forest.find(n) == forest.find(m):
                continue
            for p, q in ((p, q) for p in mine for q in other):
                few, many = sorted((len(sets[p]), len(sets[q])))
                if few < threshold * many:
                    continue
                both = np.sort(np.concatenate((sets[p], sets[q])))
                both = int((both[1:] == both[:-1]).sum())
                if both >= threshold * (few + many - both):
                    links.append((p, q))
                    forest.union(n, m)
                    break
    return links


def spread(sets: list[np.ndarray], parts: list[list[int]], threshold: float) -> list[tuple[int, int]]:
    """Links (p, q) that join all parts that similar sets connect: breadth first, each set against all that are not reached yet."""
    size = np.array([len(x) for x in sets])
    part = np.empty(len(sets), dtype=np.int64)
    for n, members in enumerate(parts):
        part[members] = n
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cuts = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(int(code.max()) + 1, dtype=np.uint8)
    left = np.arange(len(sets))
    flat, starts = code, cuts[:-1]
    links: list[tuple[int, int]] = []
    while len(left):
        front = list(parts[part[left[0]]])
        left = left[part[left] != part[left[0]]]
        while front and len(left):
            if 2 * len(left) < len(starts):  # look at what is left only
                flat = np.concatenate([code[cuts[k] : cuts[k + 1]] for k in left])
                starts = np.concatenate(([0], np.cumsum(size[left])[:-1]))
                held = left
            elif len(starts) == len(sets):
                held = np.arange(len(sets))
            p = front.pop()
            own = code[cuts[p] : cuts[p + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = 0
            near = held[both >= threshold * (size[p] + size[held] - both)]
            found = near[np.isin(near, left)]
            if len(found):
                for n in dict.fromkeys(part[found].tolist()):
                    links.append((p, int(found[part[found] == n][0])))
                    front += parts[n]
                left = left[~np.isin(part[left], part[found])]
    return links


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    width: int = 7,
    bands: int = 24,
    rows: int = 4,
    block: int = 2000,
) -> DataFrame:
    """Add n_lines, n_removed and clean_text to ``docs``, keeping one line per component of similar lines.

    Lines are cut at ``\\n``; blank ones are kept and link to nothing. Equal lines (128 bits of hashes) are one; lines whose sets of
    ``width``-byte shingles have a Jaccard similarity of ``threshold`` or more are linked if one of the MinHash
    bands agrees (at 0.8, all but three pairs in a million; above, fewer are missed). Of each component the line with the smallest (id, position)
    stays; rows equal in id and text count as one row, and keep the same lines. Null texts have no lines and stay
    null; an empty text has no line and stays. A very long text or line is taken whole, in one task's memory. Null ids come last. An empty table gives an empty one.
    Input columns named like an added one are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "clean_text")
    th, tg = F.xxhash64(text_col), F.xxhash64(F.lit(7), text_col)
    own = docs.select(F.col(id_col).alias("id"), th.alias("th"), tg.alias("tg"), F.col(text_col).alias("t"))
    at = materialize(_lines(own, "t", "id", "th", "tg").select("id", "th", "tg", "pos", "h", "g"), "lines")
    edges = near_edges(docs, text_col, at.count(), threshold, width, bands, rows, block)
    roots = materialize(connected_components(edges).select(first_half("id").alias("h"), second_half("id").alias("g"), "root"), "roots")
    # one row per distinct line first, so that a very common line is never gathered; missing ids sort last
    place = F.struct(F.col("id").isNull().alias("none"), "id", "pos", "th")
    firsts = at.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    named = firsts.join(small(roots), ["h", "g"], "left").select("h", "g", "first", "n", "root")
    keep = named.where("root is not null").groupBy("root").agg(F.min("first").alias("keep"))
    alone = named.where("root is null and n > 1").select("h", "g", F.col("first").alias("keep"))
    linked_ = named.where("root is not null").select("h", "g", "root").join(keep, "root").select("h", "g", "keep")
    keepers = materialize(alone.unionAll(linked_), "keepers")
    gone = at.join(small(keepers), ["h", "g"]).where(~place.eqNullSafe(F.col("keep"))).groupBy(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("tg").alias("__tg")).agg(F.array_sort(F.collect_set("pos")).alias("__gone"))
    gone = materialize(gone, "gone")
    many = 4 * gone.agg(F.coalesce(F.sum(F.size("__gone")), F.lit(0))).first()[0]
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (th == F.col("__th")) & (tg == F.col("__tg"))
    joined = docs.join(small(gone, many), same, "left").withColumn("__lines", F.split(F.col(text_col), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda k: F.get("__lines", k)), "\n"))
    n_lines = F.coalesce(F.size(F.filter("__lines", lambda x: F.trim(x) != "")), F.lit(0)).cast("long")
    return joined.withColumns({"clean_text": text, "n_lines": n_lines, "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}).drop("__gone", "__id", "__th", "__tg", "__lines")

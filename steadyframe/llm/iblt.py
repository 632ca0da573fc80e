"""Document fingerprints as invertible Bloom lookup sketches of paragraphs, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A paragraph: a line, or a part of 400 characters of a longer one.
PARAGRAPH = r"[^\n]{1,400}"
WIDTH = 8  # cells in each of the three subtables of a fingerprint
PART = 30  # digests of both sides in a part of a retry, whose sketch has twice the fingerprint's cells


#: Groups of words end at the blanks after a word whose last letter or sign is one of about a quarter of those of common scripts;
#: a group of more than 160 characters goes in parts of 80. Where a group ends depends on its words alone.
GROUP_END = r"\s(?<=[dhlptxDHLPTX048.,;:!?)\u00e0-\u00e4\u0431-\u0437]\s)\s*"
OPENING = 6  # groups of a text that have digests of their own
CHAIN = 16  # groups in a chain, on average


def word_groups(text: Column) -> Column:
    """Digests of groups of words: the first ``OPENING`` groups one by one, what follows in chains that end after each group whose hash divides by ``CHAIN``.

    So an edit changes only the groups and chains that it touches, a short text has fine digests, and a long one has few.
    """
    parts = lambda g: F.regexp_extract_all(g, F.lit("(?s).{1,80}"), F.lit(0))
    cut = lambda gs: F.flatten(F.transform(gs, lambda g: F.when(F.length(g) > 160, parts(g)).otherwise(F.array(g))))
    groups = _let(F.split(text, GROUP_END), lambda gs: F.when(F.exists(gs, lambda g: F.length(g) > 160), cut(gs)).otherwise(gs))
    hashes = F.transform(F.filter(groups, lambda g: g.rlike(r"\S")), lambda g: F.xxhash64(g))

    def chained(own: Column) -> Column:
        rest = F.transform(F.slice(own, OPENING + 1, F.greatest(F.size(own) - OPENING, F.lit(0))), lambda h: F.concat(F.hex(h), F.when(F.pmod(h, F.lit(CHAIN)) == 0, "\n").otherwise(" ")))
        chains = F.filter(F.split(F.array_join(rest, ""), "\n"), lambda c: c != "")
        return F.concat(F.slice(own, 1, OPENING), F.transform(chains, lambda c: F.xxhash64(c)))

    return occurrences(_let(hashes, chained), text)


def digests(text: Column) -> Column:
    """64-bit digests of a text's paragraphs."""
    return occurrences(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)), text)


def occurrences(hashes: Column, text: Column) -> Column:
    """Distinct digests of paragraphs' hashes, each with the number of its occurrence, and one of the whole text if it has any.

    So paragraphs that come once more are seen, and texts of the same paragraphs in another order differ by the last. In the
    sorted hashes equal ones stand together; how many stand before one is found by halving steps, and only where there is any.
    """

    def numbered(own: Column) -> Column:
        def before(x: Column, i: Column) -> Column:
            step = lambda m, w: F.when((i >= m + w) & (F.get(own, i - m - w) == x), m + w).otherwise(m)
            return F.when((i > 0) & (F.get(own, i - 1) == x), F.aggregate(F.lit([1 << k for k in range(26, -1, -1)]), F.lit(0), step)).otherwise(F.lit(0))

        return F.transform(own, lambda x, i: F.xxhash64(x, before(x, i)))

    whole = F.array(F.xxhash64(F.lit("whole"), text))
    return F.when(F.size(hashes) == 0, F.array().cast("array<long>")).otherwise(F.concat(_let(F.array_sort(hashes), numbered), whole))


def _key(d: Column, width: Column, seed: Column | None = None) -> Column:
    """A digest with its check and the places of its cells, one in each subtable; ``seed`` deals it to other cells."""
    from_ = d if seed is None else F.xxhash64(d, seed)
    at = [(F.pmod(F.shiftrightunsigned(from_, 20 * t), width.cast("long")) + t * width).cast("int").alias(f"p{t}") for t in range(3)]
    return F.struct(d.alias("k"), F.xxhash64(d, F.lit(17)).alias("c"), *at)


def _none() -> Column:
    return F.array().cast("array<long>")


def _hits(key: Column, j: Column) -> Column:
    return (key["p0"] == j) | (key["p1"] == j) | (key["p2"] == j)


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.cast("long").alias("k"), c.cast("long").alias("c"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(keys: Column, width: int | Column, seed: Column | None = None) -> Column:
    """Cells (n, xor of digests, xor of their checks) of an array of digests."""
    width = width if isinstance(width, Column) else F.lit(width)

    def cells(own: Column) -> Column:
        def subtable(t: int) -> Column:
            hits = lambda j: F.filter(own, lambda x: x[f"p{t}"] == j)
            return F.transform(F.sequence(t * width, (t + 1) * width - 1), lambda j: F.aggregate(hits(j), _cell(F.lit(0), F.lit(0), F.lit(0)), lambda a, x: _cell(a["n"] + 1, a["k"].bitwiseXOR(x["k"]), a["c"].bitwiseXOR(x["c"]))))

        return F.concat(*[subtable(t) for t in range(3)])

    return _let(F.transform(keys, lambda d: _key(d, width, seed)), cells)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column, width: int | Column, seed: Column | None = None, rounds: int = 10) -> Column:
    """(ok, a, b): whether the cells emptied, and the digests of each side that were recovered.

    Each round takes the digests of all pure cells out of every cell they are in.
    """
    width = width if isinstance(width, Column) else F.lit(width)

    def found(cells_: Column, side: int) -> Column:
        pure = F.filter(cells_, lambda x: (x["n"] == side) & (F.xxhash64(x["k"], F.lit(17)) == x["c"]))
        return F.array_distinct(F.transform(pure, lambda x: x["k"]))

    def state(cells_: Column, a: Column, b: Column) -> Column:
        return _let(cells_, lambda c: F.struct(c.alias("cells"), found(c, 1).alias("more"), found(c, -1).alias("less"), a.alias("a"), b.alias("b")))

    def step(s: Column, _: Column) -> Column:
        left = subtract(s["cells"], subtract(sketch(s["more"], width, seed), sketch(s["less"], width, seed)))
        return F.when((F.size(s["more"]) == 0) & (F.size(s["less"]) == 0), s).otherwise(state(left, F.concat(s["a"], s["more"]), F.concat(s["b"], s["less"])))

    def done(s: Column) -> Column:
        empty = ~F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))
        return F.struct(empty.alias("ok"), s["a"].alias("a"), s["b"].alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state(cells, _none(), _none()), step, done)


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """(a, b): the digests that only the one and only the other array has, recovered from sketches.

    First the fingerprints are subtracted and peeled; if that fails, sketches twice as large, in as many parts as
    the sizes ask for, and a part that fails again in ever larger ones, each time dealt anew. A part that no sketch peels (it takes
    digests that share all three cells four times over, less than one part in 10**9) is compared as sets.
    Parts are cut in two steps, so that time grows with the power 1.5 of the number of digests.
    """
    side = F.greatest(F.ceil(F.sqrt((F.size(a) + F.size(b)) / PART)), F.lit(1)).cast("int")
    numbers = F.sequence(F.lit(0), side - 1)

    def own(keys: Column, p: Column, seed: int) -> Column:
        return F.filter(keys, lambda d: F.pmod(F.xxhash64(d, F.lit(seed)), side.cast("long")) == p.cast("long"))

    tries = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(seed).alias("seed")) for w, seed in ((2 * WIDTH, 20), (4 * WIDTH, 21), (8 * WIDTH, 22), (8 * WIDTH, 23))])

    def tried(sides: Column) -> Column:
        x, y = sides["x"], sides["y"]
        at = lambda t: peel(subtract(sketch(x, t["width"], t["seed"]), sketch(y, t["width"], t["seed"])), t["width"], t["seed"])
        none = F.struct(F.lit(False).alias("ok"), _none().alias("a"), _none().alias("b"))
        exact = F.struct(F.lit(True).alias("ok"), F.array_except(x, y).alias("a"), F.array_except(y, x).alias("b"))
        return F.aggregate(tries, none, lambda s, t: F.when(s["ok"], s).otherwise(at(t)), lambda s: F.when(s["ok"], s).otherwise(exact))

    def split(x: Column, y: Column, p: Column, seed: int) -> Column:
        return F.struct(own(x, p, seed).alias("x"), own(y, p, seed).alias("y"))

    def row(p: Column) -> Column:  # parts of parts, as filtering the whole for each part would take the square of the size
        return _let(split(a, b, p, 5), lambda r: F.transform(numbers, lambda q: _let(split(r["x"], r["y"], q, 6), tried)))

    gathered = lambda ps: F.struct(F.lit(True).alias("ok"), F.flatten(F.transform(ps, lambda x: x["a"])).alias("a"), F.flatten(F.transform(ps, lambda x: x["b"])).alias("b"))
    return _or(peel(subtract(cells_a, cells_b), WIDTH), _let(F.flatten(F.transform(numbers, row)), gathered))


def _or(one: Column, other: Column) -> Column:
    """The one if it is ok, else the other, which is not evaluated otherwise."""
    return _let(one, lambda r: F.when(r["ok"], r).otherwise(other))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Jaccard likeness of two arrays of digests, from what their sketches' difference recovers; 1 for two empty ones."""
    both = lambda d: F.size(a) + F.size(d["b"])
    return _let(difference(a, b, cells_a, cells_b), lambda d: F.when(both(d) == 0, F.lit(1.0)).otherwise((F.size(a) - F.size(d["a"])) / F.greatest(both(d), F.lit(1))))


def render(cells: Column) -> Column:
    """A fingerprint as text: cells ``n.k.c`` in hexadecimal, comma-joined; of equal texts it is equal."""
    return F.array_join(F.transform(cells, lambda x: F.concat_ws(".", x["n"].cast("string"), F.lower(F.hex(x["k"])), F.lower(F.hex(x["c"])))), ",")


def with_next(docs: DataFrame, id_col: str, text_col: str, rows: int = 2000) -> DataFrame:
    """(id, text, next): each text with that of the next row by ascending id; after the last comes the first.

    Ids are dealt into ranges of about ``rows`` rows, and the first of a range is also sent to the range before, so that one
    shuffle of the texts suffices and no task has the whole order. Equal ids are ordered by a hash of their texts. Rows with
    a null id have no next (an empty one).
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = base.select("id").where("id is not null")
    n = ids.count()
    lost = base.where("id is null").withColumn("next", F.lit(""))
    if not n:
        return lost
    ranges = min(65_536, -(-n // rows))
    cuts = sorted(set(ids.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 100_000)).first()[0])) if ranges > 1 else []
    groups = [cuts[k : k + 256] for k in range(0, len(cuts), 256)]
    count = lambda xs, v: F.size(F.filter(xs, lambda c: c <= v))
    longs = lambda xs: F.lit(xs).cast("array<long>") if xs else F.array().cast("array<long>")
    if len(groups) <= 1:
        bucket = count(longs(cuts), F.col("id"))
    else:  # first the block of 256 cuts, then the place in it
        top = F.greatest(count(longs([g[0] for g in groups]), F.col("id")), F.lit(1))
        bucket = (top - 1) * 256 + count(F.element_at(F.array(*[longs(g) for g in groups]), top), F.col("id"))
    firsts = sorted((r["b"], r["m"]) for r in ids.groupBy(bucket.alias("b")).agg(F.min("id").alias("m")).collect())
    before = {b: (firsts[k - 1][0], int(k == 0)) for k, (b, _) in enumerate(firsts)}  # of the first range: the last, as a wrap
    size = firsts[-1][0] + 1
    mins, prev = [None] * size, [None] * size
    for b, m in firsts:
        mins[b], prev[b] = m, before[b][0]
    first_bucket = firsts[0][0]
    here = F.struct(F.col("b").alias("b"), F.lit(0).alias("wrap"), F.lit(False).alias("copy"))
    there = F.struct(F.get(F.array(*[F.lit(x).cast("int") for x in prev]), F.col("b")).alias("b"), (F.col("b") == first_bucket).cast("int").alias("wrap"), F.lit(True).alias("copy"))
    is_first = F.col("id") == F.get(F.array(*[F.lit(x).cast("long") for x in mins]), F.col("b"))
    dealt = base.where("id is not null").withColumn("b", bucket).withColumn("at", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here)))).select("id", "text", "at.b", "at.wrap", "at.copy")
    order = Window.partitionBy("b").orderBy("wrap", "id", F.xxhash64("text"), "copy")
    return dealt.withColumn("next", F.lead("text").over(order)).where("not copy").select("id", "text", "next").unionAll(lost)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: Callable[[Column], Column] = digests) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has its last floor(n/2) characters replaced by the first as many (or all) of the next document.
    ``cut`` gives the digests of a text: of lines and their parts, or of ``word_groups``, which also short and one-line texts
    share with their edited texts. Null text is empty; an empty text's fingerprint has empty cells only. Blank lines are no paragraphs. Repeated rows each get a row;
    equal ids follow each other in the order of their texts' hashes. Texts of any length are cut and compared whole. An empty table gives an empty one; only the id and text columns are read.
    """
    half = F.floor(F.col("n_chars") / 2)
    keep = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    rows = (
        with_next(docs, id_col, text_col)
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(keep, F.substring(F.coalesce("next", F.lit("")), F.lit(1), half.cast("int"))))
        .select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), cut(F.col("text")).alias("d"), cut(F.col("edited")).alias("e"), cut(F.coalesce("next", F.lit(""))).alias("x"))
        .withColumns({f"{c}_cells": sketch(F.col(c), WIDTH) for c in "dex"})
    )
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        render(F.col("d_cells")).alias("fingerprint"),
        render(F.col("e_cells")).alias("edited_fingerprint"),
        likeness(F.col("d"), F.col("e"), F.col("d_cells"), F.col("e_cells")).alias("near_edited"),
        likeness(F.col("d"), F.col("x"), F.col("d_cells"), F.col("x_cells")).alias("near_next"),
    )

"""Personal data: fixed patterns, then bootstrapped contextual extraction, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadyframe.llm.common import materialize, small

KINDS = ("email", "ip", "card", "phone")
# The same matches as the plain patterns have, leftmost and greedy, but each run of characters is entered at its start
# only and never given back, so that long runs cost linear time and no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Runs of identifier characters with a digit or an at sign; what they are trimmed to is a token if it has five characters.
RUN = r"(?<![A-Za-z0-9._@+-])[A-Za-z._+-]*+[0-9@][A-Za-z0-9._@+-]*+"
TOKEN = r"[A-Za-z0-9](.*[A-Za-z0-9])?"
#: Credentials that are known by their form wherever they stand: access keys, and long hexadecimal tokens with digits and letters.
KEY = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{16,})\z"
#: Lexical patterns before a span, of which the first that fits is taken: a label with its sign, the only word of its line so far, the two words before.
LABEL = r"(\p{L}[\p{L}0-9_]{0,31})[ \t]{0,4}([:=])[ \t]{0,4}[\x22']?\z"
OPENING = r"\n[^\p{L}\p{N}]{0,4}(\p{L}+)[^\p{L}\p{N}\n]{1,4}\z"
PAIR = r"(\p{L}+)[^\p{L}\p{N}]{1,4}(\p{L}+)[^\p{L}\p{N}]{1,4}\z"
#: Uses of labels and of lines' first words, wherever they stand.
LABEL_USE = r"(\p{L}[\p{L}0-9_]{0,31})[ \t]{0,4}([:=])"
OPENING_USE = r"^[^\p{L}\p{N}]{0,4}(\p{L}+)"


SPANS = "array<struct<start:int,end:int,value:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern as an array of (start, end, value), in code points.

    Places are counted in stretches of about as many matches as there are stretches, and the stretches then moved, so that a text of many
    matches copies no array for each of them.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast(SPANS)

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def sums(state: Column, x: Column) -> Column:
        return F.struct((state["at"] + x["at"]).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    def moved(part: Column, by: Column) -> Column:
        return F.transform(part["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))

    def whole(z: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(z))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(z) / step).cast("int") - 1), lambda k: F.aggregate(F.slice(z, k * step + 1, step), F.struct(F.lit(0).alias("at"), none.alias("out")), add))
        return bound(cut, lambda parts: F.flatten(F.zip_with(parts, F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), sums, lambda s: s["out"]), moved)))

    zipped = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    return bound(zipped, lambda z: F.when(F.size(z) > 0, whole(z)).otherwise(none))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn sum."""
    d = F.reverse(digits(value))

    def add(total: Column, k: Column) -> Column:
        x = F.substring(d, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def base_spans(text: Column, kind: str) -> Column:
    """Spans of a base kind: matches that fail its test are dropped."""
    tests = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: ~F.exists(F.split(v, r"\."), lambda p: ~p.rlike(r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
        "card": luhn,
        "phone": lambda v: F.length(digits(v)).between(8, 15),
    }
    hint = HINTS[kind]
    test = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9]")
    found = F.filter(spans(text, PATTERNS[kind]), lambda s: tests[kind](s["value"]))
    return F.when(test, found).otherwise(F.array().cast(SPANS))


def find(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    min_seeds: int = 3,
    min_confidence: float = 0.5,
) -> DataFrame:
    """One row per row of ``docs``: its id, an array of (start, end, value) per base kind, ``key`` and ``context``.

    ``key`` has the credentials that are known by their form. ``context`` has what the bootstrap alone finds: base spans and keys
    are seeds. What stands before a span is its lexical pattern. Patterns and
    the identifier-like tokens after them form a graph. In each of ``rounds`` rounds, patterns with ``min_seeds`` distinct
    trusted instances are scored by the instances they extract, over all their uses in texts that hold an identifier-like token, and
    instances by their patterns; an instance that reaches ``min_confidence`` is trusted like a seed in the next round.
    Patterns that end with ``min_confidence`` give the tokens that follow them, unless those overlap base spans or are keys.

    Null and empty texts have no spans; ids may be null or repeated, and each repeated row gets its spans and counts in the scores. Texts of any length
    are looked at whole. Ties need no order: all patterns above the bound are taken. An empty table gives an empty one; only the id and text columns are read, so that other names can't clash.
    """
    rows = materialize(scanned(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))), "spans")
    seen = materialize(apart(rows.select("rid", F.explode("tokens").alias("x")).select("rid", "x.*")), "tokens")
    accepted = good_patterns(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")), seen, rounds, min_seeds, min_confidence)
    span = F.struct("start", "end", "value")
    follows = seen.where("not base and not key and pattern <> ''").join(small(accepted), "pattern", "left_semi").select("rid", *["start", "end", "value"], F.lit(False).alias("key"))
    extra = follows.unionByName(seen.where("key").select("rid", "start", "end", "value", "key"))
    more = extra.groupBy("rid").agg(*[F.array_sort(F.collect_list(F.when(c, span))).alias(n) for n, c in (("key", F.col("key")), ("context", ~F.col("key")))])
    none = F.array().cast(SPANS)
    out = rows.drop("tokens").join(small(materialize(more, "more")), "rid", "left")
    return out.select(F.col("id").alias(id_col), *KINDS, F.coalesce("key", none).alias("key"), F.coalesce("context", none).alias("context"))


def apart(tokens: DataFrame) -> DataFrame:
    """Tokens without those that overlap a base span of their text; base spans stay."""
    by = Window.partitionBy("rid").orderBy("start")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(by.rangeBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("rid").orderBy(F.desc("start"))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(back.rangeBetween(Window.unboundedPreceding, 0))
    met = (F.coalesce(before, F.lit(0)) > F.col("start")) | F.coalesce(after < F.col("end"), F.lit(False))
    return tokens.withColumn("met", met).where("base or not met").drop("met")


def scanned(rows: DataFrame) -> DataFrame:
    """Rows (id, t) to (rid, id, spans of each base kind, tokens): one pass over the texts."""
    t = F.col("t")
    based = rows.select(F.monotonically_increasing_id().alias("rid"), "id", "t", *[base_spans(t, k).alias(k) for k in KINDS]).withColumn("base", F.flatten(F.array(*KINDS)))

    def core(s: Column) -> Column:
        start = s["start"] + F.length(F.regexp_extract(s["value"], "^[._@+-]*", 0))
        value = F.regexp_extract(s["value"], TOKEN, 0)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

    def enough(s: Column) -> Column:
        return (F.length(s["value"]) >= 5) & s["value"].rlike("[0-9@]")

    def instance(parts: Column, s: Column, base: bool) -> Column:
        key = F.lit(False) if base else s["value"].rlike(KEY)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), context(parts, s["start"]).alias("pattern"), F.lit(base).alias("base"), key.alias("key"), (F.lit(True) if base else key).alias("seed"))

    others = F.when(t.rlike("[0-9@]"), F.filter(F.transform(spans(t, RUN), core), enough)).otherwise(F.array().cast(SPANS))
    tokens = bound(blocks(t), lambda parts: F.concat(F.transform("base", lambda s: instance(parts, s, True)), F.transform(others, lambda s: instance(parts, s, False))))
    return based.select("rid", "id", *KINDS, tokens.alias("tokens"))


#: Code points of a block of a text, and of what stands before a span.
BLOCK, LEFT = 1024, 48


def blocks(text: Column) -> Column:
    """The text in blocks, each with what stands before it, so that a place is reached without walking through the text."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int")), lambda k: F.substring(text, F.greatest(k * BLOCK - LEFT, F.lit(0)) + 1, F.lit(BLOCK + LEFT)))


def context(parts: Column, start: Column) -> Column:
    """The lexical pattern before a place in a text's blocks, lower-cased; empty if there is none."""
    k = F.floor(start / BLOCK).cast("int")
    at = start - F.greatest(k * BLOCK - LEFT, F.lit(0))
    left = F.substring(F.get(parts, k), F.greatest(at - LEFT + 1, F.lit(1)), F.least(at, F.lit(LEFT)))
    left = F.lower(F.concat(F.when(start <= LEFT, "\n").otherwise(""), left))

    def pattern(x: Column) -> Column:
        got = lambda p, k: F.regexp_extract(x, p, k)
        return (
            F.when(got(LABEL, 1) != "", F.concat(got(LABEL, 1), got(LABEL, 2)))
            .when(got(OPENING, 1) != "", F.concat(F.lit("^"), got(OPENING, 1)))
            .when(got(PAIR, 1) != "", F.concat_ws(" ", got(PAIR, 1), got(PAIR, 2)))
            .otherwise("")
        )

    return bound(left, pattern)


def pattern_uses(texts: DataFrame) -> DataFrame:
    """One row (pattern) for each label, line's first word and pair of neighbouring words of texts with an identifier-like token."""
    t = F.lower("t")
    labels = F.zip_with(F.regexp_extract_all(t, F.lit(LABEL_USE), F.lit(1)), F.regexp_extract_all(t, F.lit(LABEL_USE), F.lit(2)), lambda a, b: F.concat(a, b))
    first = F.transform(F.split(t, "\n"), lambda x: F.regexp_extract(x, OPENING_USE, 1))
    openings = F.transform(F.filter(first, lambda w: w != ""), lambda w: F.concat(F.lit("^"), w))
    words = F.split(t, r"[^\p{L}]+")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return texts.where(F.col("t").rlike("[0-9@]")).select(F.explode(F.concat(labels, openings, pairs)).alias("pattern"))


def good_patterns(texts: DataFrame, seen: DataFrame, rounds: int, min_seeds: int, min_confidence: float) -> DataFrame:
    """Patterns that pass, as one column ``pattern``."""
    instances = seen.where("pattern <> ''").select("pattern", F.lower("value").alias("value"), "seed")
    edges = materialize(instances.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "pattern-edges")
    seeds = edges.where("seed").select("value").distinct().withColumn("known", F.lit(True))
    possible = edges.groupBy("pattern").agg(F.count("*").alias("k"), F.sum("n").alias("found")).where(F.col("k") >= min_seeds).drop("k")
    graph = edges.drop("seed").join(possible.select("pattern"), "pattern", "left_semi").join(seeds, "value", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    graph = materialize(graph, "pattern-graph")
    found = materialize(graph.groupBy("pattern").agg(F.sum("n").alias("found")), "pattern-found")
    uses = pattern_uses(texts).join(small(found.select("pattern")), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("uses"))
    totals = materialize(found.join(uses, "pattern", "left").select("pattern", F.greatest("found", F.coalesce("uses", F.lit(0))).alias("uses")), "pattern-uses")
    scores = graph.select("value", F.when(F.col("known"), 1.0).otherwise(0.0).alias("score")).distinct()
    for _ in range(rounds):
        trusted = F.count_if(F.col("score") >= min_confidence)
        mass = graph.join(scores, "value").groupBy("pattern").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), trusted.alias("k")).where(F.col("k") >= min_seeds)
        confident = materialize(mass.join(totals, "pattern").select("pattern", (F.col("mass") / F.col("uses")).alias("confidence")), "pattern-scores")
        best = graph.join(confident, "pattern", "left").groupBy("value", "known").agg(F.max("confidence").alias("c"))
        scores = best.select("value", F.when(F.col("known"), 1.0).otherwise(F.least(F.coalesce("c", F.lit(0.0)), F.lit(1.0))).alias("score"))
    return confident.where(F.col("confidence") >= min_confidence).select("pattern")


def rendered(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans of these columns, by kind, then start, comma-joined."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*[of(k) for k in kinds]), ",")

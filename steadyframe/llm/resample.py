"""Quality selection by importance resampling over hashed n-grams."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadyframe.llm.common import append_columns, materialize

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\x00-\x20\x7f]")
BUCKETS = 10_000


class _Hashes(dict):
    def __missing__(self, token: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = h = zlib.crc32(token)
        return h


def bucket_counts(text: str | None, hashes: dict) -> np.ndarray:
    """Counts of hashed tokens and pairs of neighbouring tokens; a token is a word or a sign."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    tokens = TOKEN.findall(raw.translate(LOWER))
    one = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
    return np.bincount(np.concatenate([one, two]).astype(np.uint64) % np.uint64(BUCKETS), minlength=BUCKETS) if len(one) else np.zeros(BUCKETS, dtype=np.int64)


def model(texts: DataFrame) -> np.ndarray:
    """Log probabilities of the buckets over all texts (one column), add-one smoothed; each task sends one row a bucket at most."""

    def partial(batches):
        total, hashes = np.zeros(BUCKETS, dtype=np.int64), _Hashes()
        for batch in batches:
            for text in batch.column(0):
                total += bucket_counts(text.as_py(), hashes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["b", "n"])

    out = np.ones(BUCKETS)
    for r in texts.mapInArrow(partial, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] += r["n"]
    return np.log(out / out.sum())


def resample(
    docs: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fraction: float = 0.5,
    target_rows: int = 20_000,
    temperature: float = 1.0,
    seed: int = 0,
    keep_text: bool = True,
    per_token: bool = False,
) -> DataFrame:
    """Add log_weight, gumbel_key and selected to ``docs``.

    Two bag-of-hashed-n-grams models are made: of all texts, and of those whose ids ``targets`` (one column) has, a
    sample of about ``target_rows`` by a hash if there are more. ``log_weight`` is the log of the importance weight, the sum of the
    log ratios of the text's n-grams under the two; ``gumbel_key`` is log_weight / temperature plus Gumbel noise that is a function
    of id, text and seed, so that at temperature 1 rows are drawn without replacement by their importance weights. ``per_token`` takes the mean in place of the sum: a form
    that length does not decide, tempered by as much as a text is long. The ceil(fraction * rows) largest keys are selected, and with them rows whose key equals the last.
    Repeated rows have equal noise and are selected together. Texts are read whole, however long. Texts without tokens (null, empty) have weight
    minus infinity and are never selected. Without targets all weights are 0; an empty table gives an empty one. ``keep_text=False`` leaves the texts
    out of the table that is written on the way. Input columns of these names are replaced.
    """
    ids = targets.select(F.col(targets.columns[0]).alias("__id")).where("__id is not null").distinct()
    n = ids.count()
    if n > target_rows:
        ids = ids.where(F.expr(f"pmod(xxhash64(cast(__id as string), 5), 1000000) < {max(1, int(1e6 * target_rows / n))}"))
    raw = model(docs.select(text_col))
    wanted = docs.join(F.broadcast(ids), F.col(id_col) == F.col("__id"), "left_semi").select(text_col)
    ratio = (model(wanted) if n else raw) - raw
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def make():
        hashes = _Hashes()

        def step(batch):
            out = []
            for text in batch.column(text_col):
                c = bucket_counts(text.as_py(), hashes)
                total = int(c.sum())
                out.append(float(c @ held.value) / (total if per_token else 1) if total else float("-inf"))
            return {"log_weight": out}

        return step

    uniform = (F.expr(f"pmod(xxhash64(cast({id_col} as string), {text_col}, {seed}), 9007199254740992)") + 0.5) / 9007199254740992.0
    keyed = append_columns(docs.drop("gumbel_key", "selected"), [T.StructField("log_weight", T.DoubleType())], make)
    noise = keyed.withColumn("gumbel_key", F.col("log_weight") / temperature - F.log(-F.log(uniform)))
    keyed = materialize(noise if keep_text else noise.drop(text_col), "keys")
    least = kth_largest(keyed, "gumbel_key", fraction)
    return keyed.withColumn("selected", F.lit(False) if least is None else (F.col("gumbel_key") >= least) & (F.col("log_weight") > float("-inf")))


def kth_largest(rows: DataFrame, col: str, fraction: float, bins: int = 4096, few: int = 10_000) -> float | None:
    """The ceil(fraction * n)-th largest finite value, exactly, by counting ever narrower bins; None without any."""
    finite = rows.where(f"{col} > double('-inf') and {col} < double('inf')").select(F.col(col).alias("v"))
    lo, hi, n = finite.agg(F.min("v"), F.max("v"), F.count("*")).first()
    k = min(n, int(np.ceil(fraction * rows.count())))
    if k <= 0:
        return None
    while n > few and lo < hi:
        width = (hi - lo) / bins
        inside = finite.where((F.col("v") >= lo) & (F.col("v") <= hi))
        counts = {r["b"]: r for r in inside.groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if k <= counts[b]["n"]:
                break
            k -= counts[b]["n"]
        last, (lo, hi, n) = (lo, hi), (counts[b]["lo"], counts[b]["hi"], counts[b]["n"])
        if (lo, hi) == last:
            break
    if lo == hi:
        return lo
    values = finite.where((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("v")).limit(few).collect()
    for r in values:
        if k <= r["n"]:
            return r["v"]
        k -= r["n"]
    return values[-1]["v"]

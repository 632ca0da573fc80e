"""Language identification by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadyframe.llm.common import append_columns

LETTER = regex.compile(r"\p{L}")
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
BUCKETS = 1 << 14
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]


def ngram_counts(text: str) -> np.ndarray:
    """How often each bucket of hashed byte trigrams of the lower-cased text occurs; its ends count as blanks."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(LOWER) + b" ", dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(BUCKETS)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    code *= np.uint32(2654435761)
    return np.bincount((code >> np.uint32(18)).astype(np.intp), minlength=BUCKETS).astype(np.float64)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all splits of up to six languages, a fixed random code of wide distance beyond."""
    if n <= 6:
        splits = [[1] + [1 if m >> k & 1 else -1 for k in range(n - 1)] for m in range(2 ** (n - 1) - 1)]
        return np.array(splits or [[1]], dtype=np.float64).T
    width = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(7)
    tries = [rng.choice([-1.0, 1.0], size=(n, width)) for _ in range(200)]
    tries = [c for c in tries if (np.abs(c.sum(0)) < n).all()] or tries
    return max(tries, key=lambda c: min((c[i] != c[j]).sum() for i in range(n) for j in range(i)))


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit: mean log-odds of an n-gram
    scale: np.ndarray  # bit: brings margins of the fitted sample near 1
    trust: np.ndarray  # language x bit: how often the bit is right for the language, rows sum to 1

    def decide(self, counts: np.ndarray, ambiguity: float) -> tuple[str, float, bool]:
        """Loss-weighted decoding: the codeword with the least weighted loss; its share of exp(-loss) is the score."""
        margin = np.clip(counts @ self.weights / max(counts.sum(), 1.0) / self.scale, -4, 4)
        loss = (np.exp(-margin * self.codes) * self.trust).sum(1)
        order = np.argsort(loss, kind="stable")
        p = np.exp(-4 * (loss - loss[order[0]]))
        score = float(1.0 / p.sum())
        return self.languages[order[0]], score, bool(len(order) > 1 and loss[order[1]] - loss[order[0]] < ambiguity)


def fit(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int = 20_000) -> Model | None:
    """Learn from about ``sample`` labelled rows at most, chosen by a hash of their ids (all, if there are fewer).

    Each bit's classifier is a naive Bayes ratio of the n-grams of the languages on either side of the split; its scale and each
    language's trust in it come from the same sample. What reaches the driver is a table of
    languages x buckets. Languages whose texts have no n-gram (empty ones) are not learned. Repeated rows count as often as they
    occur; very long texts count as whole texts and weigh as much as short ones. None without labelled rows.
    """
    rows = labelled.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where("l is not null and t is not null")
    n = rows.count()
    if not n:
        return None
    take = rows.where(F.expr(f"pmod(xxhash64(cast(i as string)), 1000000) < {max(1, min(1_000_000, int(1e6 * sample / n)))}")) if n > sample else rows

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                c = ngram_counts(text.as_py())
                sums.setdefault(lang.as_py(), np.zeros(BUCKETS))
                sums[lang.as_py()] += c / max(1.0, c.sum())
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], names=["l", "b", "c"])

    table: dict[str, np.ndarray] = {}
    for r in take.select("l", "t").mapInArrow(partial, "l string, b int, c double").groupBy("l", "b").agg(F.sum("c").alias("c")).collect():
        table.setdefault(r["l"], np.zeros(BUCKETS))[r["b"]] = r["c"]
    languages = sorted(table)
    if not languages:
        return None
    codes = codewords(len(languages))
    share = np.array([table[x] / max(table[x].sum(), 1e-12) for x in languages])
    floor = 1e-7
    weights = np.zeros((BUCKETS, codes.shape[1]))
    for k in range(codes.shape[1]):
        side = [np.log(share[codes[:, k] == s].mean(0) + floor) if (codes[:, k] == s).any() else np.full(BUCKETS, np.log(1 / BUCKETS)) for s in (1, -1)]
        weights[:, k] = side[0] - side[1]
    draft = Model(languages, codes, weights, np.ones(codes.shape[1]), np.ones_like(codes))

    def margins(batches):
        number = {x: k for k, x in enumerate(languages)}
        width = codes.shape[1]
        size, right = np.zeros((len(languages), width)), np.zeros((len(languages), width))
        rows_ = np.zeros(len(languages))
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                k = number.get(lang.as_py())
                if k is None:  # its texts have no n-gram
                    continue
                c = ngram_counts(text.as_py())
                m = c @ draft.weights / max(c.sum(), 1.0)
                size[k] += np.abs(m)
                right[k] += m * codes[k] > 0
                rows_[k] += 1
        at = [(k, b, size[k, b], right[k, b], rows_[k]) for k in range(len(languages)) for b in range(width) if rows_[k]]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in at], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()))], names=["l", "b", "s", "r", "n"])

    size, right, seen = np.zeros_like(codes), np.zeros_like(codes), np.ones_like(codes)
    for r in take.select("l", "t").mapInArrow(margins, "l int, b int, s double, r double, n double").groupBy("l", "b").agg(F.sum("s"), F.sum("r"), F.sum("n")).collect():
        size[r[0], r[1]], right[r[0], r[1]], seen[r[0], r[1]] = r[2], r[3], max(r[4], 1.0)
    scale = np.maximum(size.sum(0) / np.maximum(seen.sum(0), 1), 1e-9)
    trust = right / seen + 1e-3
    return Model(languages, codes, weights, scale, trust / trust.sum(1, keepdims=True))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", ambiguity: float = 0.02) -> DataFrame:
    """Add lang_pred, score (0 to 1) and ambiguous (the two best losses differ by less than ``ambiguity``).

    A null text or one without a letter (Unicode category L) is ``und`` with score 0 and ambiguous, as is every text without a model.
    Of languages with equal loss the first by name is given, marked ambiguous. Texts of any length are counted whole; equal texts get
    equal results; an empty table gives an empty one. Input columns of these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)

    def make():
        m = Model(**held.value) if held.value else None

        def step(batch):
            out: dict[str, list] = {f.name: [] for f in FIELDS}
            for text in batch.column(text_col):
                text = text.as_py()
                got = m.decide(ngram_counts(text), ambiguity) if m and text and LETTER.search(text) else ("und", 0.0, True)
                for name, v in zip(out, got):
                    out[name].append(v)
            return out

        return step

    return append_columns(docs, FIELDS, make)

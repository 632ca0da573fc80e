"""The training-data operators do the whole job: cases that earlier versions left out."""

import random
import string
import timeit

import numpy as np
from pyspark.sql import functions as F

from steadyframe.llm import iblt, linededup, packing, queries


def jaccard(a, b, width=7):
    cut = lambda raw: {raw[k : k + width] for k in range(max(1, len(raw) - width + 1))}
    x, y = cut(a.encode()), cut(b.encode())
    return len(x & y) / len(x | y)


# --- op4


def test_added_tokens_inside_texts_as_in_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # as it is: added tokens are found in texts
    end = "<|endoftext|>"
    texts = [f"one {end} two", end, end * 3, f"{end}a  {end}\n\n b{end} ", f"<|endoftext|{end}>", "<|endoftext", "", f"\u00e9{end}\U0001f600 {end}x's"]
    texts += [end + "some words, and\n\n  more of them 12 " * 40_000 + end + " z"]
    got = packing.bpe_encoder("byte_bpe_50k.json")()(texts)
    assert got[0].tolist() == [505, 220, 50256, 734]
    for text, ids in zip(texts, got):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


# --- op6


def test_pairs_at_the_threshold_meet_by_default(spark):
    """Lines in pairs a little above the threshold, each pair of words of its own: as many stay as by brute force."""
    rng = random.Random(21)
    rows, want = [], 0
    for k in range(2000):
        one = "".join(rng.choices(string.ascii_lowercase + " ", k=120)).strip()
        at = rng.randrange(20, 60)
        two = one[:at] + "".join(rng.choices(string.digits, k=rng.choice((11, 12, 13)))) + one[at:]
        if 0.8 <= jaccard(one, two) < 0.84:
            rows += [(2 * k, one), (2 * k + 1, two)]
            want += 1
    assert want > 1000
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.agg(F.sum("n_removed")).first()[0] == want


def test_shingles_are_windows_and_cheap():
    """The windows of lines of every length as sets, and a cost well below a pass for each byte of the window."""
    rng = np.random.default_rng(23)
    for width in range(1, 9):
        for n in [*range(1, 20), 300]:
            raw = rng.choice(np.array([0, 1, 97, 255], dtype=np.uint8), n).tobytes()
            whole = raw.ljust(width, b"\0")
            want = {whole[k : k + width] for k in range(len(whole) - width + 1)}
            got = linededup.shingles(raw, width)
            assert (got[1:] > got[:-1]).all() and {int(x).to_bytes(8, "little")[:width] for x in got} == want and len(got) == len(want)

    def passes(raw, width):
        buf = np.frombuffer(raw, dtype=np.uint8)
        out = np.zeros(len(buf) - width + 1, dtype=np.uint64)
        for k in range(width):
            out = (out << np.uint64(8)) | buf[k : k + len(out)]
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]

    raw = rng.integers(97, 123, 300, dtype=np.uint8).tobytes()
    cost = lambda f: min(timeit.repeat(lambda: f(raw, 7), number=300, repeat=9))
    assert cost(linededup.shingles) < 0.75 * cost(passes)


# --- op9


def test_edited_one_line_texts_stay_near(spark, tmp_path):
    rng = random.Random(22)
    text = lambda n: " ".join("".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(n))
    sizes = [40, 60, 100, 300, 6000] * 6
    rows = [(k, text(n)) for k, n in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_document_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.near_edited > r.near_next for r in got)
    # one word more at the front leaves what follows alike, and the ladder gives the sets' exact likeness
    pairs = spark.createDataFrame([(f"new {t}", t) for _, t in rows], "a string, b string").select(iblt.word_groups(F.col("a")).alias("a"), iblt.word_groups(F.col("b")).alias("b"))
    cells = [iblt.sketch(F.col(c), iblt.WIDTH) for c in "ab"]
    for r in pairs.select("a", "b", iblt.likeness(F.col("a"), F.col("b"), *cells).alias("v")).collect():
        assert r.v > 0.5 and abs(r.v - len({*r.a} & {*r.b}) / len({*r.a} | {*r.b})) < 1e-9

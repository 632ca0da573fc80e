"""The pipeline's stages in order, on planted documents, with the stages' promises checked."""

import random

import pytest

import corpus_pipeline


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(1)
    kinds = {"en": [f"the{k}ing" for k in range(300)], "de": [f"ung{k}sch" for k in range(300)]}
    text = lambda lang, n: "\n".join(" ".join(rng.choices(kinds[lang], k=18)) for _ in range(n))
    rows = [(k, text("en" if k % 2 else "de", 6), "en" if k % 2 else "de") for k in range(60)]
    passage = " ".join(f"item{k}" for k in range(30))
    rows += [(100, rows[1][1], "en"), (101, rows[1][1].replace("ing", "ing", 1) + " more", "en"), (102, text("en", 5) + "\n" + passage + "\n" + text("en", 3), "en"), (103, passage, "en"), (104, None, None), (105, "123 456", None)]
    full = [(i, t, lang, "s", len(t) if t else None) for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), {i: t for i, t, _ in rows}


def test_stages(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(texts) - set(seen["language_id"]) == {104, 105}
    assert 100 not in seen["line_dedup"] and set(range(60)) <= set(seen["simhash_near_dedup"])
    last = seen["benchmark_decontamination"]
    assert 103 not in last and "item3" not in last[102].text and last[102].n_chars == len(last[102].text) and set(range(60)) <= set(last)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in packed} == set(last)
    assert {(r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, path).collect()} == {(r.doc_id, r.piece, r.length) for r in packed}


def test_clashing_columns_and_odd_rows(spark, tmp_path):
    """Columns named like those that operators add come out as they were; nulls, repeats and a very long text pass every stage."""
    rng = random.Random(3)
    text = lambda n: "\n".join(" ".join(f"the{rng.randrange(900)}ing" for _ in range(20)) for _ in range(n))
    rows = [(k, text(4), "en" if k % 2 else "de") for k in range(40)] + [(50, text(3000), "en")]
    rows += [rows[0], (60, None, None), (61, "", "en"), (None, text(4), None)]
    extra = ["score", "ambiguous", "lang_pred", "n_lines", "n_removed", "clean_text", "coverage", "spans", "n_hit", "fp", "id", "key", "c1", "root"]
    full = [(i, t, lang, "s", len(t) if t is not None else None, *[f"{c}{i}" for c in extra]) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some other words " * 5)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert all(r[c] == f"{c}{r.doc_id}" for r in docs.collect() for c in extra)
    ids = [r.doc_id for r in docs.collect()]
    assert {50, None} <= set(ids) and len(ids) == len(set(ids)) and set(range(1, 40)) <= set(ids)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

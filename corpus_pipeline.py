"""Corpus pipeline: language id, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadyframe.llm import decontam, langid, linededup, packing, simhash
from steadyframe.llm.common import materialize, release, tables_made

#: Documents of which benchmark passages make up this share or more go as a whole; from others the passages are cut.
MAX_COVERAGE = 0.5


def _named(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1 ..., so that none clashes with what an operator adds, and the name of each column here."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(found: DataFrame, names: dict[str, str], text: Column | None = None) -> DataFrame:
    """The columns of documents again; with ``text``, that is their text, and n_chars its length."""
    new = {} if text is None else {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; null texts, texts without a letter and ambiguous ones go. Repeated rows stay; without any
    labelled text all go."""
    rows, names = _named(docs)
    model = langid.fit(rows, names["text"], names["lang"], names["doc_id"])
    return _back(langid.identify(rows, model, names["text"]).where("lang_pred <> 'und' and not ambiguous"), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one line of each component of similar lines; documents left without any line go. Documents that have no line (null,
    empty or blank text) stay; rows equal in id and text keep the same lines."""
    rows, names = _named(docs)
    found = linededup.dedup_lines(rows, names["doc_id"], names["text"])
    return _back(found.where("n_removed = 0 or n_removed < n_lines"), names, F.col("clean_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies (five words, similarity 0.8); texts without words are copies of each other, and so are repeated rows."""
    rows, names = _named(docs)
    return _back(simhash.drop_near_copies(rows, names["doc_id"], names["text"]), names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages; documents mostly made of them go. Null and empty texts stay; repeated rows are treated alike."""
    rows, names = _named(docs)
    found = decontam.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names["text"])
    return _back(found.where(F.col("coverage") < MAX_COVERAGE), names, F.col("clean_text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens into sequences of at most 1024. Null and empty texts are the end token alone; each repeated row is packed."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has neither the tokenizer nor the hashes; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again as the next one's input. What a stage wrote on its way, and its input, are then deleted."""
    gone: set[str] = set()  # some are deleted on the way
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with tables_made() as made:
            docs = materialize(stage(spark, docs, sf_dir), name)
        for table in [*before, *made[:-1]]:
            if table._written not in gone:
                gone.add(table._written)
                release(table)
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)

"""Experiment registry, best epoch, quality gate and report rows."""

from __future__ import annotations

import html
import json
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyframe.operators.detection import best_row

# The order of the twelve COCO statistics.
COCO_STATS = ["map", "map_50", "map_75", "map_small", "map_medium", "map_large", "mar_1", "mar_10", "mar_100", "mar_small", "mar_medium", "mar_large"]


RECORD = "name string, architecture string, checkpoint string, config string, metrics map<string,map<string,double>>, notes string, registered_at string"


def upsert(registry: DataFrame, records: DataFrame, key: str = "name") -> DataFrame:
    """The registry with ``records`` in place of those of the same name."""
    return registry.join(records.select(key), key, "left_anti").unionByName(records)


def _hadoop(spark, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def latest(spark, folder: str) -> tuple[int, DataFrame | None]:
    """(version, table) of a registry; (0, None) where there is none yet."""
    store, path = _hadoop(spark, folder)
    names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
    versions = sorted(int(n[1:-5]) for n in names if re.fullmatch(r"v\d{9}\.json", n))
    if not versions:
        return 0, None
    table = spark.read.text(f"{folder}/v{versions[-1]:09d}.json").first()[0]
    return versions[-1], spark.read.schema(RECORD).parquet(f"{folder}/{json.loads(table)['table']}")


def register(spark, folder: str, new: DataFrame, tries: int = 20) -> int:
    """Add experiments to the registry in a folder of any file system that Hadoop reads; gives the new version's number.

    A version is a table and a numbered file that names it. The file is created only if no other writer has made that number; else the newer version is read and
    the experiments are put into it, so that none of two writers' is lost. Readers see whole versions only.
    """
    store, path = _hadoop(spark, folder)
    for _ in range(tries):
        version, known = latest(spark, folder)
        table = f"table-{uuid.uuid4().hex}.parquet"
        (new if known is None else upsert(known, new)).coalesce(1).write.parquet(f"{folder}/{table}")
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{version + 1:09d}.json")
        try:
            out = store.create(marker, False)
        except Exception as e:  # py4j wraps what the file system throws
            if not store.exists(marker):
                raise
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}"), True)
            del e
            continue
        out.write(bytearray(json.dumps({"table": table}).encode()))
        out.close()
        return version + 1
    raise RuntimeError(f"{tries} times another writer was first")


def record(spark, name: str, architecture: str, checkpoint: str, metrics: dict[str, dict[str, float]], config: str | None = None, notes: str = "") -> DataFrame:
    """One experiment's row, with the time at which it was registered in UTC."""
    now = datetime.now(timezone.utc).isoformat()
    return spark.createDataFrame([(name, architecture, checkpoint, config, metrics, notes, now)], RECORD)


def best_experiment(registry: DataFrame, order: str = "registered_at") -> DataFrame:
    """The experiment with the highest validation map, then map_75; without validation metrics none is eligible, a missing value counts as -1."""
    val = F.col("metrics")["val"]
    keyed = registry.where(val.isNotNull()).withColumns({"k1": F.coalesce(val["map"], F.lit(-1.0)), "k2": F.coalesce(val["map_75"], F.lit(-1.0))})
    return best_row(keyed, ["k1", "k2"], order).drop("k1", "k2")


def best_epoch(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The epoch with the best first statistic, then third; raises on an empty log."""
    if log.isEmpty():
        raise ValueError("the log has no rows")
    stats = log.withColumns({"s0": F.get("stats", 0), "s2": F.get("stats", 2)})
    return best_row(stats, ["s0", "s2"], "epoch", keys).drop("s0", "s2")


def stats_to_map(stats: str = "stats"):
    """Twelve COCO statistics as a map by name; another number of them raises."""
    named = F.map_from_arrays(F.lit(COCO_STATS), F.col(stats))
    return F.when(F.size(stats) == 12, named).otherwise(F.raise_error(F.lit("12 statistics are needed")))


def quality_gate(metrics: DataFrame) -> DataFrame:
    """Add ``passes``: map_50 of .50 and map of .25 at least; missing values count as 0."""
    return metrics.withColumn("passes", (F.coalesce("map_50", F.lit(0.0)) >= 0.5) & (F.coalesce("map", F.lit(0.0)) >= 0.25))


def stale_epochs(log: DataFrame, patience: int, value: str = "map_score") -> DataFrame:
    """Add how many epochs ago the best so far was, and whether training stops there."""
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy("epoch")
    best = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = log.withColumn("better", F.coalesce(F.col(value) > best, F.lit(True)))
    last = F.max(F.when(F.col("better"), F.col("epoch"))).over(w)
    return out.withColumn("stale", F.col("epoch") - last).withColumn("stops", F.col("stale") >= patience).drop("better")


def report_html(title: str, sections: dict[str, list[dict]]) -> str:
    """A small report of collected summary rows."""
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, rows in sections.items():
        head = list(rows[0]) if rows else []
        cells = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[c]))}</td>" for c in head) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in head)}</tr>{cells}</table>")
    return "\n".join(parts)


def report_markdown(title: str, sections: dict[str, list[dict]]) -> str:
    """The same report in Markdown."""
    plain = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    parts = [f"# {title}"]
    for name, rows in sections.items():
        head = list(rows[0]) if rows else []
        lines = [" | ".join(plain(c) for c in head), " | ".join("---" for _ in head)] + [" | ".join(plain(r[c]) for c in head) for r in rows]
        parts.append(f"## {name}\n\n" + "\n".join(f"| {x} |" for x in lines if head))
    return "\n\n".join(parts) + "\n"


def report_title(smoke: bool, passes: bool, independent: bool) -> str:
    """Which kind of report the results allow."""
    if smoke:
        return "Smoke run: not a result"
    return "Formal evaluation" if passes and independent else "Independent test, gate not passed" if independent else "Segment hold-out, cases not independent"

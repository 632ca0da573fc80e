"""Stand-ins for the pipeline's tables, made of the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRACKS = """
select concat('C', cast(user_id % 10 as string)) as case_id,
 concat('C', cast(user_id % 10 as string), '_', cast(user_id as string)) as segment_id,
 f as frame_idx, cast(f as double)/5.0 as time_s,
 case when event_type='error' then null else case when event_id % 11 = 0 then 2 else 1 end end as track_id,
 case when event_type='error' then null when event_type='signup' then 'Other' else 'Harmonic0' end as class_name,
 case when event_type='error' then null else cast((event_id*37) % 100 as double)/100 end as confidence,
 case when event_type='error' then null else cast(600 + abs((f*12) % 800 - 400) + event_id % 7 as double) end as x1,
 case when event_type='error' then null else cast(300 + abs((f*7) % 500 - 250) + event_id % 5 as double) end as y1,
 case when event_type='error' then null else cast(800 + abs((f*12) % 800 - 400) + event_id % 7 as double) end as x2,
 case when event_type='error' then null else cast(420 + abs((f*7) % 500 - 250) + event_id % 5 as double) end as y2,
 1920 as frame_width, 1080 as frame_height, event_id
from (select *, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as f from events) e
"""

#: All candidates of every frame, ranked.
CANDIDATES = """
select *, row_number() over (partition by segment_id, frame_idx order by score desc, k1, k2, k3) as candidate_rank from (
select concat('S', cast(l_suppkey % 10 as string)) as segment_id, l_partkey % 200 as frame_idx,
 cast((l_orderkey*7919 + l_linenumber*104729 + l_partkey*31) % 9973 + 1 as double)/9974 as score,
 cast(gx + dx as double) as x1, cast(gy + dy as double) as y1, cast(gx + dx + 180 as double) as x2, cast(gy + dy + 120 as double) as y2,
 cast(gx as double) as gt_x1, cast(gy as double) as gt_y1, cast(gx + 200 as double) as gt_x2, cast(gy + 130 as double) as gt_y2,
 l_orderkey as k1, l_linenumber as k2, l_partkey as k3
from (select *, 300 + abs(((l_partkey % 200)*12) % 1600 - 800) as gx, 200 + abs(((l_partkey % 200)*7) % 900 - 450) as gy,
  (l_orderkey*13 + l_linenumber*29) % 160 - 80 as dx, (l_orderkey*11 + l_linenumber*17) % 90 - 45 as dy from lineitem) a) b
"""

#: Up to four ground-truth boxes a frame, large to small, some of them crowds.
TRUTHS = """
select segment_id, frame_idx, g as truth_id, cast(gx + 25 * g as double) as x1, cast(gy + 15 * g as double) as y1, cast(gx + 200 - 35 * g as double) as x2, cast(gy + 130 - 25 * g as double) as y2,
 g = 3 and frame_idx % 2 = 0 or g = 1 and frame_idx % 5 = 0 as crowd
from (select distinct concat('S', cast(l_suppkey % 10 as string)) as segment_id, l_partkey % 200 as frame_idx, l_linenumber % 4 as g,
  300 + abs(((l_partkey % 200)*12) % 1600 - 800) as gx, 200 + abs(((l_partkey % 200)*7) % 900 - 450) as gy from lineitem where (l_orderkey + l_linenumber) % 3 = 0) a
"""

RATINGS = """
select concat('C', cast((o_custkey % 100) % 20 as string)) as case_id, concat('S', cast(o_custkey % 100 as string)) as segment_id,
 o_orderpriority as rater_id, cast(cast(floor(o_totalprice/1000) as bigint) % 25 as double) as salas_total,
 cast(cast(floor(o_totalprice/100) as bigint) % 40 as double) as osa_cns_total from orders
"""

LABEL_LINES = """
select case when p_size % 2 = 0 then 'VID001_B' else 'VID001_C' end as segment_id, p_partkey as frame_idx,
 concat('0,', cast(p_partkey % 3 as string), ',', cast(cast(p_partkey % 97 + 1 as double)/100 as string), ',', cast(cast(p_partkey % 89 + 1 as double)/100 as string), ',', cast(cast(p_size as double)/100 as string), ',', cast(cast(p_partkey % 37 + 1 as double)/100 as string)) as raw_line from part
"""

IMAGES = "select vec_id as image_id, 8 as width, 8 as height, embedding as pixels from embeddings"

EPOCHS = "select event_id, user_id as run_id, props as payload, value as map_score from events"

#: Segment metrics by order counts, one row per customer class: features for the ratings.
SEGMENT_FEATURES = """
select concat('C', cast((o_custkey % 100) % 20 as string)) as case_id, concat('S', cast(o_custkey % 100 as string)) as segment_id,
 cast(count(*) as double) as n_orders, cast(sum(o_orderkey % 97) as double) as key_mass, cast(max(o_orderkey % 13) as double) as key_top from orders
group by 1, 2
"""

SQL = {"tracks": TRACKS, "candidates": CANDIDATES, "truths": TRUTHS, "ratings": RATINGS, "label_lines": LABEL_LINES, "images": IMAGES, "epochs": EPOCHS, "segment_features": SEGMENT_FEATURES}
SOURCES = {"tracks": "events", "candidates": "lineitem", "truths": "lineitem", "ratings": "orders", "label_lines": "part", "images": "embeddings", "epochs": "events", "segment_features": "orders"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stand-in table; its SQL reads the driver's table under a name of its own."""
    source = SOURCES[name]
    return spark.sql(SQL[name].replace(f"from {source}", "from {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))

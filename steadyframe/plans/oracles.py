"""DuckDB SQL for the registered queries, written from the definitions."""

from __future__ import annotations

from steadyframe.operators.audit import case_splits
from steadyframe.operators.detection import thresholds
from steadyframe.plans import fixtures

SEG = "partition by case_id, segment_id"
ORD = f"{SEG} order by frame_idx"


def rd(x: str, name: str | None = None) -> str:
    return f"round({x} + 3e-8, 6) + 0.0 as {name or x}"


def ctes(*parts: tuple[str, str]) -> str:
    return "with " + ",\n".join(f"{n} as ({q})" for n, q in parts)


def iou(a: str = "", b: str = "gt_") -> str:
    w = f"greatest(0.0::double, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    h = f"greatest(0.0::double, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    area = lambda p: f"greatest(0.0::double, {p}x2 - {p}x1) * greatest(0.0::double, {p}y2 - {p}y1)"
    return f"({w} * {h}) / greatest({area(a)} + {area(b)} - {w} * {h}, 1e-12::double)"


# --- trajectory

TRACKS = ("tracks", fixtures.TRACKS)
Q = ("q", "select *, coalesce(class_name = 'Harmonic0' and confidence >= 0.53::double, false) as q from tracks")
DOMINANT = (
    "dominant",
    f"select case_id, segment_id, track_id, count(distinct frame_idx) as detected_frames, avg(confidence) as mean_confidence from q where q and track_id is not null group by case_id, segment_id, track_id qualify row_number() over ({SEG} order by count(distinct frame_idx) desc, round(avg(confidence), 9) desc, track_id) = 1",
)
OWN = "q.q and (d.track_id is null or coalesce(q.track_id = d.track_id, false))"
FRAMES = (
    "frames",
    "select case_id, segment_id, frame_idx, min(time_s) as time_s, bool_or(q) as any_detected, bool_or(own) as detected, "
    + ", ".join(f"max(case when own then {c} end) as {c}" for c in ("confidence", "x1", "y1", "x2", "y2"))
    + f" from (select q.*, {OWN} as own from q left join dominant d using (case_id, segment_id)) o group by case_id, segment_id, frame_idx",
)
STEPS = (
    "steps",
    f"""select *, greatest(1, round_even(0.6::double / dt, 0)) as max_gap from (
  select *, coalesce(median(case when gap > 0 then gap end) over ({SEG}), 1.0::double) as dt from (
    select *, (x1 + x2) / 2 / 1920 as x, (y1 + y2) / 2 / 1080 as y, row_number() over ({ORD}) - 1 as rn, time_s - lag(time_s) over ({ORD}) as gap from frames) a) b""",
)


def _filled(c: str) -> str:
    back, ahead = f"over ({ORD} rows between unbounded preceding and current row)", f"over ({ORD} rows between current row and unbounded following)"
    known = f"case when {c} is not null then rn end"
    return f"last_value({known} ignore nulls) {back} as {c}_pi, last_value({c} ignore nulls) {back} as {c}_pv, first_value({known} ignore nulls) {ahead} as {c}_ni, first_value({c} ignore nulls) {ahead} as {c}_nv"


def _line(c: str) -> str:
    return f"case when {c} is not null then {c} when {c}_ni is not null and rn - {c}_pi <= max_gap then {c}_pv + ({c}_nv - {c}_pv) * (rn - {c}_pi) / ({c}_ni - {c}_pi) end as {c}_i"


FILLED = ("filled", f"select *, {_line('x')}, {_line('y')} from (select *, {_filled('x')}, {_filled('y')} from steps) n")

# The parabola weights over five frames, in 35ths, by place.
WEIGHTS = [[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3], [-5, 6, 12, 13, 9], [3, -5, -3, 9, 31]]


def _smoothed(c: str) -> str:
    def row(place: int) -> str:
        terms = [f"{w} * lag({c}_i, {place - j}) over {c}w" if place > j else f"{w} * lead({c}_i, {j - place}) over {c}w" if j > place else f"{w} * {c}_i" for j, w in enumerate(WEIGHTS[place])]
        return "(" + " + ".join(terms) + ") / 35.0::double"

    k, n = f"(row_number() over {c}w)", f"(count(*) over (partition by case_id, segment_id, {c}_i is null))"
    return f"case when {c}_i is null or {n} < 6 then {c}_i when {k} = 1 then {row(0)} when {k} = 2 then {row(1)} when {k} = {n} then {row(4)} when {k} = {n} - 1 then {row(3)} else {row(2)} end as {c}_s"


SMOOTH = ("smooth", f"select *, {_smoothed('x')}, {_smoothed('y')} from filled window xw as (partition by case_id, segment_id, x_i is null order by frame_idx), yw as (partition by case_id, segment_id, y_i is null order by frame_idx)")


def derivative(source: str, target: str, c: str, name: str) -> tuple[str, str]:
    g = "partition by case_id, segment_id, has, run"
    return (
        target,
        f"""select * exclude (has, run, a, b, f0, f1, ok), case when not has or not ok then null when a is not null and b is not null then (a*a*f1 + b*b*f0) / (a*b*(a+b)) when b is not null then f1 / b when a is not null then f0 / a end as {name} from (
  select *, bool_and(coalesce(a > 0, true)) over ({g}) as ok from (
    select *, time_s - lag(time_s) over w as a, lead(time_s) over w - time_s as b, {c} - lag({c}) over w as f0, lead({c}) over w - {c} as f1 from (
      select *, row_number() over ({ORD}) - row_number() over (partition by case_id, segment_id, {c} is not null order by frame_idx) as run, {c} is not null as has from {source}) e
    window w as ({g} order by frame_idx)) f) h""",
    )


MOTION = [
    derivative("smooth", "m1", "x_s", "vx"),
    derivative("m1", "m2", "y_s", "vy"),
    derivative("m2", "m3", "vx", "ax"),
    derivative("m3", "m4", "vy", "ay"),
    ("m5", "select *, sqrt(ax*ax + ay*ay) as acceleration, sqrt(vx*vx + vy*vy) as speed, sqrt((x_s-0.5)*(x_s-0.5) + (y_s-0.5)*(y_s-0.5)) as radial, sqrt((x_i-x_s)*(x_i-x_s) + (y_i-y_s)*(y_i-y_s)) as jitter from m4"),
    derivative("m5", "motion", "acceleration", "jerk"),
]
BASE = [TRACKS, Q, DOMINANT, FRAMES, STEPS]
FULL = [*BASE, FILLED, SMOOTH, *MOTION]


def gaps(flag: str, name: str) -> tuple[str, str]:
    runs = f"select case_id, segment_id, {flag}, row_number() over ({ORD}) - row_number() over (partition by case_id, segment_id, {flag} order by frame_idx) as run from frames"
    return (name, f"select case_id, segment_id, count(*) as gap_count, max(n) as longest from (select case_id, segment_id, run, count(*) as n from ({runs}) a where not {flag} group by all) b group by all")


LATENCY = (
    "latency",
    f"select case_id, segment_id, frame_idx, until - time_s as latency_s from (select *, lead(time_s) over ({ORD}) as until from (select *, coalesce(lag(radial > 0.2) over ({ORD}) <> (radial > 0.2), true) as change from motion where radial is not null) a where change) b where radial > 0.2 and until is not null",
)

SEGMENT = f"""select case_id, segment_id, m.frame_count, {rd('duration_s')}, {rd('detection_rate')}, {rd('dominant_track_coverage_rate')}, {rd('centered_rate_detected')},
 {rd('mean_center_distance')}, {rd('p95_center_distance')}, {rd('out_of_view_rate')}, {rd('mean_speed')}, {rd('p95_speed')}, {rd('mean_acceleration')}, {rd('mean_abs_jerk')}, {rd('jitter_rms')},
 coalesce(l.n, 0) as recenter_event_count, {rd('l.s', 'mean_recenter_latency_s')}, coalesce(a.gap_count, 0) as detection_gap_count, {rd('coalesce(a.longest, 0) * dt', 'longest_detection_gap_s')},
 coalesce(t.gap_count, 0) as dominant_track_gap_count, {rd('coalesce(t.longest, 0) * dt', 'longest_dominant_track_gap_s')}, dominant_track_coverage_rate >= 0.8::double as trajectory_metrics_reliable
from (select case_id, segment_id, count(*) as frame_count, max(time_s) - min(time_s) as duration_s, avg(any_detected::int) as detection_rate, avg(detected::int) as dominant_track_coverage_rate,
  coalesce(avg((radial <= 0.2)::int) filter (detected and radial is not null), 0.0) as centered_rate_detected, avg(radial) as mean_center_distance, quantile_cont(radial, 0.95) as p95_center_distance,
  coalesce(avg((x_s < 0 or x_s > 1 or y_s < 0 or y_s > 1)::int) filter (x_s is not null and y_s is not null), 0.0) as out_of_view_rate, avg(speed) as mean_speed, quantile_cont(speed, 0.95) as p95_speed,
  avg(acceleration) as mean_acceleration, avg(abs(jerk)) as mean_abs_jerk, sqrt(avg(jitter*jitter)) as jitter_rms, min(dt) as dt from motion group by all) m
left join (select case_id, segment_id, count(*) as n, avg(latency_s) as s from latency group by all) l using (case_id, segment_id)
left join g_any a using (case_id, segment_id) left join g_own t using (case_id, segment_id)"""

LEGACY = f"""{ctes(TRACKS)},
f as (select case_id, segment_id, frame_idx, time_s, max(case when class_name = 'Harmonic0' and confidence >= 0.25::double then (x1+x2)/2/1920 end) as x,
  max(case when class_name = 'Harmonic0' and confidence >= 0.25::double then (y1+y2)/2/1080 end) as y from tracks group by all),
a as (select *, sqrt((x-0.5)*(x-0.5)+(y-0.5)*(y-0.5)) as radial, case when time_s - lag(time_s) over w > 0 then time_s - lag(time_s) over w end as dt,
  sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as move from f window w as ({SEG} order by time_s, frame_idx)),
b as (select *, move / dt as speed from a), c as (select *, (speed - lag(speed) over ({SEG} order by time_s, frame_idx)) / dt as acceleration from b),
e as (select *, (acceleration - lag(acceleration) over ({SEG} order by time_s, frame_idx)) / dt as jerk from c)
select case_id, segment_id, count(*) as frame_count, {rd('max(time_s) - min(time_s)', 'duration_s')}, {rd('avg((x is not null)::int)', 'detection_rate')}, {rd('coalesce(avg((radial <= 0.2)::int) filter (x is not null), 0.0)', 'centered_rate')},
 {rd('avg(radial)', 'mean_center_distance')}, {rd('quantile_cont(radial, 0.95)', 'p95_center_distance')}, {rd('avg(speed)', 'mean_speed')}, {rd('quantile_cont(speed, 0.95)', 'p95_speed')},
 {rd('avg(abs(acceleration))', 'mean_abs_acceleration')}, {rd('avg(abs(jerk))', 'mean_abs_jerk')} from e group by case_id, segment_id"""

# --- candidates

CANDIDATES = ("c", fixtures.CANDIDATES)
SCORED = ("s", f"select *, {iou()} as iou from c")
TOP = ("top", "select * from s where candidate_rank = 1")
ERRORS = (
    "errors",
    """select segment_id, frame_idx, max(score) as top_score, max(case when candidate_rank = 1 then iou end) as top_iou, max(iou) as best_iou_any, count(*) filter (score >= 0.25::double) as predictions_at_025,
 min(gt_x1) as gt_x1, min(gt_y1) as gt_y1, min(gt_x2) as gt_x2, min(gt_y2) as gt_y2, (min(gt_x2) - min(gt_x1)) * (min(gt_y2) - min(gt_y1)) / (1920.0::double * 1080.0::double) as gt_area_fraction,
 (min(gt_x1) + min(gt_x2)) / 2 / 1920 as gt_center_x, (min(gt_y1) + min(gt_y2)) / 2 / 1080 as gt_center_y, case when segment_id < 'S5' then 'val' else 'test' end as split from s group by segment_id, frame_idx""",
)
EDGES = ("edges", "select quantile_cont(gt_area_fraction, 0.33) as e0, quantile_cont(gt_area_fraction, 0.67) as e1 from errors where split = 'val'")
BUCKETS = (
    "b",
    """select e.* exclude (r, n), case when gt_area_fraction <= e0 then 'small' when gt_area_fraction <= e1 then 'medium' else 'large' end as area_bucket,
 case when sqrt(pow(gt_center_x - 0.5, 2) + pow(gt_center_y - 0.5, 2)) > 0.4::double then 'edge' else 'central' end as position_bucket,
 concat('Q', cast(greatest(1, ceil(4 * (r - 1) / greatest(n - 1, 1)::double)) as integer)) as time_quartile
from (select *, row_number() over (partition by split order by frame_idx, segment_id) as r, count(*) over (partition by split) as n from errors) e, edges""",
)
CAND = [CANDIDATES, SCORED]


def rates(tp: str, fp: str, fn: str) -> tuple[str, str, str]:
    p, r = f"coalesce({tp} / nullif({tp} + {fp}, 0)::double, 0)", f"coalesce({tp} / nullif({tp} + {fn}, 0)::double, 0)"
    return p, r, f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)"


def confusion(score: str, overlap: str, t: str, level: float) -> str:
    said, fits = f"{score} >= {t}", f"{overlap} >= {level}::double"
    return f"count(*) filter ({said} and {fits}) as tp, count(*) filter ({said} and not {fits}) as fp, count(*) filter (not ({said} and {fits})) as fn"


def sweep(source: str, score: str, overlap: str, values: list[float], level: float = 0.5) -> str:
    p, r, f = rates("tp", "fp", "fn")
    grid = "[" + ", ".join(f"{v!r}::double" for v in values) + "]"
    return f"select threshold, tp, fp, fn, {p} as precision, {r} as recall, {f} as f1 from (select threshold, {confusion(score, overlap, 'threshold', level)} from {source}, (select unnest({grid}) as threshold) t group by threshold) u"


SWEPT = f"{rd('threshold')}, tp, fp, fn, {rd('precision')}, {rd('recall')}, {rd('f1')}"
CASE_ERROR = "case when top_score < 0.53::double then 'missed_low_confidence' when top_iou < 0.5::double then 'localization_iou_below_050' when top_iou < 0.75::double then 'localization_iou_050_to_075' else 'correct_iou_075' end"


def summary(source: str, key: str) -> str:
    both = ", ".join(confusion("score", "iou", "0.53::double", lv).replace(" as tp", f" as tp_{n}").replace(" as fp", f" as fp_{n}").replace(" as fn", f" as fn_{n}") for lv, n in ((0.5, 50), (0.75, 75)))
    return f"select {key}, count(*) as frames, {rd('avg(iou)', 'mean_iou')}, {rd('avg((iou >= 0.5::double)::int)', 'iou50_rate')}, {rd('avg((iou >= 0.75::double)::int)', 'iou75_rate')}, {both} from {source} group by {key}"


PATH = f"""with recursive c as ({fixtures.CANDIDATES}),
k as (select *, dense_rank() over (partition by segment_id order by frame_idx) as pos, greatest(x2-x1, 1e-6::double) * greatest(y2-y1, 1e-6::double) as size from c where candidate_rank <= 5),
walk as (
 select segment_id, pos, candidate_rank as r, ln(score) as total, [candidate_rank] as path from k where pos = 1
 union all
 select n.segment_id, n.pos, n.candidate_rank, max(n.total) as total, arg_max(n.path, n.total) from (
  select b.segment_id, b.pos, b.candidate_rank, list_append(w.path, b.candidate_rank) as path,
   w.total + ln(b.score) + 2.0::double * {iou('a.', 'b.')} / sqrt(b.frame_idx - a.frame_idx)
    - 0.25::double * (sqrt(pow((a.x1+a.x2-b.x1-b.x2)/2, 2) + pow((a.y1+a.y2-b.y1-b.y2)/2, 2)) / greatest(sqrt(a.size) * (b.frame_idx - a.frame_idx), 1e-6::double))
    - 0.1::double * abs(ln(b.size / a.size)) / (b.frame_idx - a.frame_idx) as total
  from walk w join k a on a.segment_id = w.segment_id and a.pos = w.pos and a.candidate_rank = w.r join k b on b.segment_id = w.segment_id and b.pos = w.pos + 1) n
 group by n.segment_id, n.pos, n.candidate_rank),
ends as (select segment_id, arg_max(path, total) as path from walk where (segment_id, pos) in (select (segment_id, max(pos)) from k group by segment_id) group by segment_id),
chosen as (select k.*, {iou('k.', 'k.gt_')} as iou from ends join k on k.segment_id = ends.segment_id and k.candidate_rank = ends.path[k.pos])"""

_AREAS = "(values ('all', 0.0::double, 1e10::double), ('small', 0.0, 1024.0), ('medium', 1024.0, 9216.0), ('large', 9216.0, 1e10)) v(area, low, high)"
COCO = f"""{ctes(*CAND)},
h as (select s.*, t, iou >= t as fits from s, (select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::double[]) as t) o where candidate_rank <= 100),
f as (select *, fits and sum(fits::int) over (partition by segment_id, frame_idx, t order by candidate_rank) = 1 as match, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) as own, greatest(gt_x2 - gt_x1, 0) * greatest(gt_y2 - gt_y1, 0) as gt from h),
m as (select f.*, area, match as hit from f, {_AREAS} where case when match then gt between low and high else own between low and high end),
i as (select area, count(*)::double as n from (select distinct segment_id, frame_idx, area from f, {_AREAS} where gt between low and high) q group by area),
g as (select area, t, score, sum(hit::int) as tp, count(*) as k from m group by all),
r as (select area, t, sum(tp) over w / n as recall, sum(tp) over w / sum(k) over w::double as p from g join i using (area) window w as (partition by area, t order by score desc)),
o as (select area, n, t from i, (select distinct t from h) q),
ap as (select o.area, o.t, avg(coalesce((select max(p) from r where r.area = o.area and r.t = o.t and recall * 100 + 1e-9 >= q), 0)) as ap from o, range(0, 101) x(q) group by all),
mr as (select o.area, o.t, coalesce(sum((hit and candidate_rank <= 1)::int), 0) / max(n) as r1, coalesce(sum((hit and candidate_rank <= 10)::int), 0) / max(n) as r10, coalesce(sum((hit and candidate_rank <= 100)::int), 0) / max(n) as r100 from o left join m using (area, t) group by all),
b as (select * from ap join mr using (area, t))
select {rd("coalesce(avg(ap) filter (area = 'all'), -1)", 'map')}, {rd("coalesce(max(ap) filter (area = 'all' and t = 0.5::double), -1)", 'map_50')}, {rd("coalesce(max(ap) filter (area = 'all' and t = 0.75::double), -1)", 'map_75')},
 {", ".join(rd(f"coalesce(avg(ap) filter (area = '{x}'), -1)", f"map_{x}") for x in ("small", "medium", "large"))}, {", ".join(rd(f"coalesce(avg(r{k}) filter (area = 'all'), -1)", f"mar_{k}") for k in (1, 10, 100))},
 {", ".join(rd(f"coalesce(avg(r100) filter (area = '{x}'), -1)", f"mar_{x}") for x in ("small", "medium", "large"))} from b"""

_OVERLAPS = "(select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::double[]) as t)"
_BOTH = "greatest(0.0::double, least(c.x2, u.x2) - greatest(c.x1, u.x1)) * greatest(0.0::double, least(c.y2, u.y2) - greatest(c.y1, u.y1))"
#: Detections take truths one after the other: step k of the recursion is the detection of rank k of every image, area and overlap.
COCO_CROWD = f"""with recursive c as ({fixtures.CANDIDATES}), truths as ({fixtures.TRUTHS}),
p as (select c.segment_id, c.frame_idx, c.candidate_rank as rank, u.truth_id, u.crowd, (u.x2 - u.x1) * (u.y2 - u.y1) as gt,
   {_BOTH} / case when u.crowd then (c.x2 - c.x1) * (c.y2 - c.y1) else (c.x2 - c.x1) * (c.y2 - c.y1) + (u.x2 - u.x1) * (u.y2 - u.y1) - {_BOTH} end as iou
  from c join truths u on c.segment_id = u.segment_id and c.frame_idx = u.frame_idx where candidate_rank <= 100),
near as (select segment_id, frame_idx, rank, t, area, truth_id, crowd, not crowd and gt between low and high as real, iou from p, {_OVERLAPS} o, {_AREAS} where iou >= t),
walk as (select segment_id, frame_idx, t, area, 0::bigint as rank, []::bigint[] as taken, false as matched, false as hit from (select distinct segment_id, frame_idx, t, area from near) q
  union all
  select w.segment_id, w.frame_idx, w.t, w.area, w.rank + 1, case when count(n.truth_id) > 0 and not arg_max(n.crowd, (n.real::int, n.iou, n.truth_id)) then list_append(any_value(w.taken), arg_max(n.truth_id, (n.real::int, n.iou, n.truth_id))::bigint) else any_value(w.taken) end,
   count(n.truth_id) > 0, coalesce(arg_max(n.real, (n.real::int, n.iou, n.truth_id)), false)
  from walk w left join near n on n.segment_id = w.segment_id and n.frame_idx = w.frame_idx and n.t = w.t and n.area = w.area and n.rank = w.rank + 1 and not list_contains(w.taken, n.truth_id)
  where w.rank < 100 group by w.segment_id, w.frame_idx, w.t, w.area, w.rank),
h as (select c.segment_id, c.frame_idx, c.score, candidate_rank, o.t, v.area, coalesce(matched, false) as matched, coalesce(hit, false) as hit, (x2 - x1) * (y2 - y1) between low and high as inside
  from c cross join {_OVERLAPS} o cross join {_AREAS} left join walk w on w.segment_id = c.segment_id and w.frame_idx = c.frame_idx and w.t = o.t and w.area = v.area and w.rank = candidate_rank where candidate_rank <= 100),
m as (select * from h where case when matched then hit else inside end),
i as (select area, count(*)::double as n from truths, {_AREAS} where not crowd and (x2 - x1) * (y2 - y1) between low and high group by area),
g as (select area, t, score, sum(hit::int) as tp, count(*) as k from m group by all),
r as (select area, t, sum(tp) over w / n as recall, sum(tp) over w / sum(k) over w::double as p from g join i using (area) window w as (partition by area, t order by score desc)),
o as (select area, n, t from i, (select distinct t from h) q),
ap as (select o.area, o.t, avg(coalesce((select max(p) from r where r.area = o.area and r.t = o.t and recall * 100 + 1e-9 >= q), 0)) as ap from o, range(0, 101) x(q) group by all),
mr as (select o.area, o.t, coalesce(sum((hit and candidate_rank <= 1)::int), 0) / max(n) as r1, coalesce(sum((hit and candidate_rank <= 10)::int), 0) / max(n) as r10, coalesce(sum((hit and candidate_rank <= 100)::int), 0) / max(n) as r100 from o left join m using (area, t) group by all),
b as (select * from ap join mr using (area, t))
select {rd("coalesce(avg(ap) filter (area = 'all'), -1)", 'map')}, {rd("coalesce(max(ap) filter (area = 'all' and t = 0.5::double), -1)", 'map_50')}, {rd("coalesce(max(ap) filter (area = 'all' and t = 0.75::double), -1)", 'map_75')},
 {", ".join(rd(f"coalesce(avg(ap) filter (area = '{x}'), -1)", f"map_{x}") for x in ("small", "medium", "large"))}, {", ".join(rd(f"coalesce(avg(r{k}) filter (area = 'all'), -1)", f"mar_{k}") for k in (1, 10, 100))},
 {", ".join(rd(f"coalesce(avg(r100) filter (area = '{x}'), -1)", f"mar_{x}") for x in ("small", "medium", "large"))} from b"""


def side(name: str, step: int) -> str:
    return f"""{name} as (select a.segment_id, a.frame_idx, a.k1, a.k2, a.k3, max({iou('a.', 'b.')}) / sqrt(max(abs(b.frame_idx - a.frame_idx))) as overlap, max({iou('a.', 'b.')} * b.fs) / sqrt(max(abs(b.frame_idx - a.frame_idx))) as support
 from u a join u b on a.segment_id = b.segment_id and b.pos = a.pos + ({step}) and abs(b.frame_idx - a.frame_idx) <= 5 group by all)"""


SUPPORT = f"""{ctes(CANDIDATES)},
u as (select distinct segment_id, frame_idx, k1, k2, k3, x1, y1, x2, y2, greatest(1e-6::double, least(1 - 1e-6::double, score)) as fs, dense_rank() over (partition by segment_id order by frame_idx) as pos from c),
{side('p', -1)}, {side('n', 1)}
select u.segment_id, u.frame_idx, u.k1, u.k2, u.k3, {rd('coalesce(p.overlap, 0)', 'previous_overlap')}, {rd('coalesce(p.support, 0)', 'previous_support')}, {rd('coalesce(n.overlap, 0)', 'next_overlap')}, {rd('coalesce(n.support, 0)', 'next_support')}
from u left join p using (segment_id, frame_idx, k1, k2, k3) left join n using (segment_id, frame_idx, k1, k2, k3)"""

# --- ratings

RATINGS = ("ratings", fixtures.RATINGS)
FEATURES = ("features", fixtures.SEGMENT_FEATURES)
LONG = (
    "long",
    "select case_id, segment_id, feature, score, x, y from (select f.case_id, f.segment_id, unnest([{feature: 'n_orders', x: n_orders}, {feature: 'key_mass', x: key_mass}, {feature: 'key_top', x: key_top}], recursive := true), salas, osa from features f join (select case_id, segment_id, avg(salas_total) as salas, avg(osa_cns_total) as osa from ratings group by all) m using (case_id, segment_id)) a, lateral (values ('salas_total', salas), ('osa_cns_total', osa)) v(score, y)",
)


def icc(score: str) -> str:
    return f"""select '{score}' as score, n, k, {rd('case when n >= 2 and k >= 2 then (msr - mse) / nullif(msr + (k - 1) * mse + k * (msc - mse) / n, 0) end', 'icc')} from (
 select n, k, rows_ / (n - 1) as msr, cols_ / (k - 1) as msc, rest / ((n - 1) * (k - 1)) as mse from (
  select count(distinct segment_id || case_id) as n, count(distinct rater_id) as k, sum(pow(rm - gm, 2)) as rows_, sum(pow(cm - gm, 2)) as cols_, sum(pow(v - rm - cm + gm, 2)) as rest from (
   select *, avg(v) over (partition by case_id, segment_id) as rm, avg(v) over (partition by rater_id) as cm, avg(v) over () as gm from (
    select *, count(*) over (partition by case_id, segment_id) as c from (select case_id, segment_id, rater_id, avg({score}) as v from ratings group by all) a) b
   where c = (select count(distinct rater_id) from ratings)) d) e) f"""


def pearson(x: str, y: str, t: str = "1") -> str:
    n = f"sum({t})::double"
    s = lambda e: f"sum({t} * {e})"
    return f"({n} * {s(f'{x}*{y}')} - {s(x)} * {s(y)}) / nullif(sqrt(({n} * {s(f'{x}*{x}')} - {s(x)} * {s(x)}) * ({n} * {s(f'{y}*{y}')} - {s(y)} * {s(y)})), 0)"


def bootstrap() -> str:
    rank = lambda v: f"sum(times) over (partition by feature, score, rep order by {v}) - (sum(times) over (partition by feature, score, rep, {v}) - 1) / 2"
    return f"""{ctes(RATINGS, FEATURES, LONG)},
cases as (select feature, score, case_id, row_number() over (partition by feature, score order by case_id) - 1 as i, count(*) over (partition by feature, score) as n from (select distinct feature, score, case_id from long) a),
draws as (select feature, score, rep, cast('0x' || substr(md5(concat_ws('|', '42', feature, score, rep, k)), 1, 15) as bigint) % n as i
  from (select feature, score, n, rep, unnest(range(n)) as k from (select distinct feature, score, n from cases) b, range(2000) r(rep)) c),
plan as (select feature, score, rep, case_id, count(*) as times from draws join cases using (feature, score, i) group by all),
d as (select feature, score, rep, times, {rank('x')} as rx, {rank('y')} as ry from long join plan using (feature, score, case_id)),
r as (select feature, score, rep, {pearson('rx', 'ry', 'times')} as rho from d group by all)
select feature, score, {rd('quantile_cont(rho, 0.025)', 'ci95_low')}, {rd('quantile_cont(rho, 0.975)', 'ci95_high')}, count(rho) as repetitions from r group by feature, score"""


# --- labels

BAD_LINES = "values ('VID001_B', -1, '0,1,0.5'), ('VID001_B', -2, '0,1,1.5,0.5,0.1,0.1'), ('VID001_C', -3, '7,1,0.5,0.5,0.1,0.1'), ('VID001_C', -4, 'a,1,0.5,0.5,0.1,0.1'), ('VID001_C', -5, '  ')"
LINES = ("lines", f"{fixtures.LABEL_LINES} union all {BAD_LINES}")
_FIELDS = [("class_id", "integer"), ("object_id", "integer"), ("cx", "double"), ("cy", "double"), ("width", "double"), ("height", "double")]
PARSED = (
    "parsed",
    f"""select *, case when len(p) <> 6 then 'expected 6 columns' when class_id is null or object_id is null then 'not an integer' when class_id <> 0 then 'unknown class'
 when not coalesce(least(cx, cy, width, height) > 0 and greatest(cx, cy, width, height) <= 1, false) or cx is null or cy is null or width is null or height is null then 'invalid normalized box' end as error
from (select segment_id, frame_idx, p, {', '.join(f'try_cast(trim(p[{k + 1}]) as {t}) as {n}' for k, (n, t) in enumerate(_FIELDS))} from (select *, string_split(trim(raw_line), ',') as p from lines where trim(raw_line) <> '') a) b""",
)
GOOD = ("good", "select *, frame_idx / 5.0::double as time_s from parsed where error is null")
SHAPE = ("shape", "select *, width * height as box_area_norm, width / height as aspect_ratio, least(cx - width/2, cy - height/2, 1 - (cx + width/2), 1 - (cy + height/2)) as boundary_margin from good")
SPEED = (
    "speed",
    "select *, case when dt <= 2.0 then move / greatest(dt, 0.2::double) end as position_speed from (select *, time_s - lag(time_s) over w as dt, sqrt(pow(cx - lag(cx) over w, 2) + pow(cy - lag(cy) over w, 2)) as move from shape window w as (partition by segment_id order by frame_idx)) a",
)


def zscore(source: str, target: str, c: str, name: str) -> tuple[str, str]:
    return (
        target,
        f"select * exclude (med, mad, sd), ({c} - med) / case when mad >= 1e-12 then mad else sd end as {name} from (select *, 1.4826::double * median(abs({c} - med)) over (partition by segment_id) as mad, greatest(stddev_pop({c}) over (partition by segment_id), 1e-12::double) as sd from (select *, median({c}) over (partition by segment_id) as med from {source}) a) b",
    )


LABELS = [LINES, PARSED, GOOD]
_PIXELS = """select vec_id as image_id, list_transform(embedding, lambda v: v::double) as p from embeddings"""
_LAPLACE = """select image_id, p, list_transform(range(0, 64), lambda k:
  p[case when k // 8 = 0 then 1 else k // 8 - 1 end * 8 + k % 8 + 1] + p[case when k // 8 = 7 then 6 else k // 8 + 1 end * 8 + k % 8 + 1]
  + p[k // 8 * 8 + case when k % 8 = 0 then 1 else k % 8 - 1 end + 1] + p[k // 8 * 8 + case when k % 8 = 7 then 6 else k % 8 + 1 end + 1] - 4 * p[k + 1]) as lap from i"""
PICTURES = [("i", _PIXELS), ("l8", _LAPLACE), ("pics", "select image_id % 100 as n, min(list_avg(p)) as brightness, min(list_var_pop(lap)) as blur_variance from l8 group by 1")]
SEEN = ("seen", "select speed.*, brightness, blur_variance from speed left join pics on n = frame_idx % 100")
LIGHT = [zscore("seen", "za", "brightness", "brightness_z"), zscore("za", "zb", "blur_variance", "blur_z")]
SCORES = [*LABELS, SHAPE, SPEED, *PICTURES, SEEN, *LIGHT, zscore("zb", "z1", "box_area_norm", "area_z"), zscore("z1", "z2", "aspect_ratio", "aspect_z"), zscore("z2", "z3", "position_speed", "speed_z")]
_REASONS = [("small_box", "area_z", 1), ("large_box", "area_z", -1), ("extreme_aspect", "abs(aspect_z)", -1), ("boundary_box", "boundary_margin", 1), ("position_jump", "speed_z", -1), ("dark_frame", "brightness_z", 1), ("bright_frame", "brightness_z", -1), ("blurred_frame", "blur_z", 1)]

IMAGE = f"""{ctes(*PICTURES[:2])}
select image_id, round(list_avg(p) + 3e-8, 6) + 0.0 as brightness, round(list_stddev_pop(p) + 3e-8, 6) + 0.0 as contrast, round(list_var_pop(lap) + 3e-8, 6) + 0.0 as blur_variance from l8"""


SPEARMAN = f"{ctes(RATINGS, FEATURES, LONG)}, k as (select *, rank() over (partition by feature, score order by x) + (count(*) over (partition by feature, score, x) - 1) / 2 as rx, rank() over (partition by feature, score order by y) + (count(*) over (partition by feature, score, y) - 1) / 2 as ry from long)"


def beta(a: str, b: str, x: str) -> str:
    """The regularized incomplete beta function by its continued fraction, for x up to (a + 1) / (a + b + 2)."""
    even, odd = f"m * ({b} - m) * ({x}) / (({a} + 2 * m - 1) * ({a} + 2 * m))", f"-({a} + m - 1) * ({a} + {b} + m - 1) * ({x}) / (({a} + 2 * m - 2) * ({a} + 2 * m - 1))"
    value = f"list_reduce(list_transform(range(300, 0, -1), lambda k: k::double), lambda v, m: 1 + ({odd}) / (1 + ({even}) / v), 1.0::double)"
    return f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - ({x}))) / ({a} * ({value}))"


def student(rho: str, n: str) -> str:
    """Two-sided p of a correlation."""
    a, x = f"(({n} - 2) / 2.0::double)", f"(1 - {rho} * {rho})"
    low, high = beta(a, "0.5::double", x), beta("0.5::double", a, f"({rho} * {rho})")
    return f"case when {n} <= 2 then 1.0 when abs({rho}) >= 1 then 0.0 when {x} > ({a} + 1) / ({a} + 2.5) then 1 - {high} else {low} end"


def ridge() -> str:
    """Each case's ridge of three standardized features on all other cases, solved by determinants, with its predictions."""
    c = ["1.0::double", "n_orders", "key_mass", "key_top", "salas_total"]
    at = [(i, j) for i in range(5) for j in range(i, 5)]
    m = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    cov = lambda i, j: f"({m(i, j)} / m00 - m0{i} / m00 * (m0{j} / m00))"
    sd = ", ".join(f"case when sqrt(greatest({cov(k, k)}, 0)) < 1e-12 then 1.0 else sqrt(greatest({cov(k, k)}, 0)) end as s{k}" for k in (1, 2, 3))
    z = [[f"{cov(i, j)} / (s{i} * s{j}) * m00" + (" + 1.0" if i == j else "") for j in (1, 2, 3)] for i in (1, 2, 3)]
    y = [f"{cov(i, 4)} / s{i} * m00" for i in (1, 2, 3)]
    cells = ", ".join(f"{z[i][j]} as z{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(f"{y[i]} as y{i}" for i in range(3))

    def det(column: int | None) -> str:
        e = [[f"y{i}" if j == column else f"z{i}{j}" for j in range(3)] for i in range(3)]
        return " + ".join(f"{e[0][j]} * ({e[1][(j + 1) % 3]} * {e[2][(j + 2) % 3]} - {e[1][(j + 2) % 3]} * {e[2][(j + 1) % 3]})" for j in range(3))

    b = ", ".join(f"({det(k)}) / ({det(None)}) / s{k + 1} as b{k + 1}" for k in range(3))
    return f"""{ctes(RATINGS, FEATURES)}, d as (select f.*, y.salas_total from features f join (select case_id, segment_id, avg(salas_total) as salas_total from ratings group by all) y using (case_id, segment_id) where y.salas_total is not null),
own as (select case_id, {", ".join(f"sum({c[i]} * {c[j]}) as o{i}{j}" for i, j in at)} from d group by case_id),
rest as (select case_id, {", ".join(f"sum(o{i}{j}) over () - o{i}{j} as m{i}{j}" for i, j in at)} from own),
s as (select *, {sd} from rest), z as (select *, {cells} from s), b as (select *, {b} from z),
p as (select d.*, m04 / m00 + b1 * (n_orders - m01 / m00) + b2 * (key_mass - m02 / m00) + b3 * (key_top - m03 / m00) as predicted from d join b using (case_id))"""


def oracle_sql() -> dict[str, str]:
    cases = ", ".join(f"('{c}', '{s}')" for c, s in case_splits([f"C{k}" for k in range(10)], 0.15, 0.15, 5, 42).items())
    p, r, f = rates("tp", "fp", "fn")
    return {
        "segment_metrics": f"{ctes(*FULL, gaps('any_detected', 'g_any'), gaps('detected', 'g_own'), LATENCY)} {SEGMENT}",
        "best_per_frame": f"{ctes(TRACKS, Q, DOMINANT, FRAMES)} select case_id, segment_id, frame_idx, time_s, any_detected, detected, confidence, x1, y1, x2, y2 from frames",
        "dominant_track": f"{ctes(TRACKS, Q, DOMINANT)} select case_id, segment_id, track_id, detected_frames, {rd('mean_confidence')} from dominant",
        "frame_spine_join": f"{ctes(TRACKS, Q, DOMINANT, FRAMES)} select segment_id, frame_idx, time_s, x1, x2 from frames",
        "detection_gaps": f"{ctes(*BASE, gaps('any_detected', 'g'))} select g.case_id, g.segment_id, gap_count, longest, {rd('longest * dt', 'longest_s')} from g join (select segment_id, min(dt) as dt from steps group by 1) s using (segment_id)",
        "interpolate_short": f"{ctes(*BASE, FILLED)} select segment_id, frame_idx, {rd('x_i')}, {rd('y_i')} from filled",
        "savgol_smooth": f"{ctes(*BASE, FILLED, SMOOTH)} select segment_id, frame_idx, {rd('x_s')}, {rd('y_s')} from smooth",
        "gradient_runs": f"{ctes(*FULL)} select segment_id, frame_idx, {rd('speed')}, {rd('acceleration')}, {rd('jerk')}, {rd('jitter')} from motion",
        "recenter_latency": f"{ctes(*FULL, LATENCY)} select segment_id, frame_idx, {rd('latency_s')} from latency",
        "legacy_metrics": LEGACY,
        "center_distance": f"{ctes(TRACKS, Q)} select event_id, {rd('(x1+x2)/2/1920', 'x')}, {rd('(y1+y2)/2/1080', 'y')}, {rd('sqrt(pow((x1+x2)/2/1920 - 0.5, 2) + pow((y1+y2)/2/1080 - 0.5, 2))', 'radial')} from q where q",
        "gated_track": f"{ctes(*CAND, TOP)}, spine as (select segment_id, unnest(range(0, max(frame_idx) + 1)) as frame_idx from top group by segment_id) select segment_id, frame_idx, " + ", ".join(rd(f"case when score >= 0.53::double then {c} end", n) for c, n in (("x1", "x1"), ("y1", "y1"), ("x2", "x2"), ("y2", "y2"), ("score", "confidence"))) + ", case when score >= 0.53::double then 1 end as track_id from spine left join top using (segment_id, frame_idx)",
        "detection_rate": f"{ctes(*CAND, TOP)} select segment_id, {rd('count(*) filter (score >= 0.53::double) / (max(frame_idx) + 1)::double', 'detection_rate')}, max(frame_idx) + 1 as frames from top group by segment_id",
        "box_iou": f"{ctes(*CAND)} select distinct k1, k2, k3, segment_id, {rd('iou')} from s",
        "top_k_candidates": f"{ctes(CANDIDATES)} select segment_id, frame_idx, cast(candidate_rank as integer) as rank, {rd('score')}, k1, k2, k3 from c where candidate_rank <= 3",
        "threshold_sweep": f"{ctes(*CAND, TOP)} select {SWEPT} from ({sweep('top', 'score', 'iou', thresholds(0.01, 0.99, 99))}) z",
        "best_operating_point": f"{ctes(*CAND, ERRORS)} select {SWEPT} from ({sweep("(select * from errors where split = 'val') v", 'top_score', 'top_iou', thresholds(0.05, 0.95, 91))}) z order by z.f1 desc, z.precision desc, z.threshold limit 1",
        "selection_summary": f"{ctes(*CAND, TOP)} {summary('top', 'segment_id')}",
        "per_image_errors": f"{ctes(*CAND, ERRORS)} select segment_id, frame_idx, split, predictions_at_025, " + ", ".join(rd(c) for c in ("top_score", "top_iou", "best_iou_any", "gt_x1", "gt_y1", "gt_x2", "gt_y2", "gt_area_fraction", "gt_center_x", "gt_center_y")) + " from errors",
        "error_taxonomy": f"{ctes(*CAND, ERRORS)} select split, {CASE_ERROR} as error_type, count(*) as n from errors group by all",
        "area_buckets": f"{ctes(*CAND, ERRORS, EDGES, BUCKETS)} select split, area_bucket, position_bucket, count(*) as n from b group by all",
        "time_quartile": f"{ctes(*CAND, ERRORS, EDGES, BUCKETS)} select segment_id, frame_idx, split, time_quartile from b",
        "group_diagnostics": f"{ctes(*CAND, ERRORS, EDGES, BUCKETS)}, u as (select top_score, top_iou, unnest([{{dimension: 'area_bucket', bucket: area_bucket}}, {{dimension: 'position_bucket', bucket: position_bucket}}, {{dimension: 'time_quartile', bucket: time_quartile}}], recursive := true) from b where split = 'test'), g as (select dimension, bucket, count(*) as n, avg(top_iou) as mean_top_iou, {confusion('top_score', 'top_iou', '0.53::double', 0.5)} from u group by all) select dimension, bucket, n, {rd('mean_top_iou')}, tp, fp, fn, {rd(p, 'precision')}, {rd(r, 'recall')}, {rd(f, 'f1')} from g",
        "top_errors": f"{ctes(*CAND, ERRORS)} select segment_id, frame_idx, {rd('top_score')}, {rd('top_iou')}, {rd('error_priority')} from (select *, case when top_score >= 0.53::double then 1 - top_iou else 1 + 0.53::double - top_score end as error_priority from errors where split = 'test') a order by round(a.error_priority, 9) desc, segment_id, frame_idx limit 12",
        "ranking_failures": f"{ctes(*CAND, ERRORS)} select count(*) filter (top_iou < 0.5::double and best_iou_any >= 0.5::double) as failures, count(*) as images from errors where split = 'test'",
        "coco_map": COCO,
        "coco_map_crowd": COCO_CROWD,
        "clip_boxes": f"{ctes(CANDIDATES)} select distinct k1, k2, k3, segment_id, greatest(350.0::double, least(1000.0::double, x1)) as x1, greatest(250.0::double, least(600.0::double, y1)) as y1 from c",
        "viterbi_path": f"{PATH} select segment_id, frame_idx, {rd('score')}, k1, k2, k3, 1 as temporal_rank from chosen",
        "framewise_baseline": f"{ctes(*CAND, TOP)} select segment_id, frame_idx, {rd('score')}, k1, k2, k3 from top",
        "temporal_evaluation": f"{PATH}, top as (select *, {iou()} as iou from c where candidate_rank = 1), both_ as (select 0 as param_id, score, iou from top union all select 1, score, iou from chosen) {summary('both_', 'param_id')}",
        "neighbor_support": SUPPORT,
        "candidate_features": f"{ctes(CANDIDATES)}, d as (select segment_id, frame_idx, k1, k2, k3, min(candidate_rank) as candidate_rank, min(greatest(1e-6::double, least(1 - 1e-6::double, score))) as fs, min(x1) as x1, min(y1) as y1, min(x2) as x2, min(y2) as y2 from c group by all) select segment_id, frame_idx, k1, k2, k3, {rd('ln(fs / (1 - fs))', 'score_logit')}, {rd('1 / candidate_rank::double', 'rank_reciprocal')}, {rd('(x1 + x2) / 3840', 'center_x')}, {rd('(y1 + y2) / 2160', 'center_y')}, {rd('(x2 - x1) / 1920', 'box_width')}, {rd('(y2 - y1) / 1080', 'box_height')}, {rd('ln((x2 - x1) / 1920 * ((y2 - y1) / 1080) + 1e-8::double)', 'log_area')}, {rd('ln((x2 - x1) / 1920 / ((y2 - y1) / 1080))', 'log_aspect')} from d",
        "kfold_frames": f"{ctes(CANDIDATES)} select segment_id, frame_idx, cast(ntile(5) over (partition by segment_id order by frame_idx) - 1 as integer) as fold from (select distinct segment_id, frame_idx from c) a",
        "oracle_selection": f"{ctes(*CAND)} select segment_id, frame_idx, k1, k2, k3, {rd('iou')} from s qualify row_number() over (partition by segment_id, frame_idx order by round(iou, 9) desc, k1, k2, k3) = 1",
        "mean_ratings": f"{ctes(RATINGS)} select case_id, segment_id, {rd('avg(salas_total)', 'salas_total')}, {rd('avg(osa_cns_total)', 'osa_cns_total')} from ratings group by case_id, segment_id",
        "icc_2_1": f"{ctes(RATINGS)} {icc('salas_total')} union all {icc('osa_cns_total')}",
        "spearman": f"{SPEARMAN} select feature, score, count(*) as n, count(distinct case_id) as independent_cases, {rd(pearson('rx', 'ry'), 'spearman_rho')} from k group by feature, score",
        "spearman_p": f"{SPEARMAN} select feature, score, {rd(student('rho', 'n'), 'p_value')} from (select feature, score, count(*) as n, {pearson('rx', 'ry')} as rho from k group by feature, score) q",
        "loco_ridge": f"{ridge()} select case_id, segment_id, {rd('salas_total')}, {rd('predicted')} from p",
        "loco_ridge_scores": f"{ridge()} select {rd('avg(abs(salas_total - predicted))', 'mae')}, {rd('1 - sum(pow(salas_total - predicted, 2)) / (count(*) * var_pop(salas_total))', 'r2')} from p",
        "bootstrap_ci": bootstrap(),
        "parse_labels": f"{ctes(LINES, PARSED)} select segment_id, frame_idx, coalesce(class_id, -1) as class_id, coalesce(object_id, -1) as object_id, cx, cy, width, height, error from parsed",
        "parse_identity": "with n as (select concat('VID', lpad(cast(s_suppkey as varchar), 3, '0'), case s_suppkey % 3 when 0 then '' when 1 then '_B_5fps' else '_5fps' end, '.mp4') as name from supplier union all values ('clip.mp4'), ('CH2001.mp4')), m as (select name, regexp_replace(name, '\\.mp4$', '') as stem from n), e as (select name, stem, regexp_extract(stem, '^(VID\\d+)(?:_([A-Za-z0-9]+))?(?:_\\d+fps)?$', 1) as c, regexp_extract(stem, '^(VID\\d+)(?:_([A-Za-z0-9]+))?(?:_\\d+fps)?$', 2) as p from m) select name, case when name = 'CH2001.mp4' then 'CH2001' when c = '' then stem else c end as case_id, case when name = 'CH2001.mp4' then 'CH2001_CH001' when c = '' then stem when p = '' then c else c || '_' || p end as segment_id from e",
        "audit_label_sets": f"{ctes(LINES, PARSED)}, o as (select segment_id, string_agg(object_id || ':' || n, ',' order by object_id) as object_ids from (select segment_id, object_id, count(*) as n from parsed where error is null group by all) a group by segment_id) select segment_id as path, substr(segment_id, 1, 6) as case_id, segment_id, count(*) as label_files, count(*) filter (error is null) as annotation_rows, min(frame_idx) filter (error is null) as minimum_frame, max(frame_idx) filter (error is null) as maximum_frame, any_value(object_ids) as object_ids, case when segment_id = 'VID001_C' and max(frame_idx) filter (error is null) >= 10 then 'excluded_label_frame_out_of_range' else 'ready' end as status from parsed join o using (segment_id) group by segment_id",
        "pixel_boxes": f"{ctes(*LABELS)}, e as (select *, greatest(0, least(1, cx - width/2)) * 1920 as x, greatest(0, least(1, cy - height/2)) * 1080 as y, greatest(0, least(1, cx + width/2)) * 1920 as x2, greatest(0, least(1, cy + height/2)) * 1080 as y2 from good) select segment_id, frame_idx, {rd('x')}, {rd('y')}, {rd('x2 - x', 'w')}, {rd('y2 - y', 'h')}, {rd('(x2 - x) * (y2 - y)', 'area')} from e",
        "assign_ids": f"{ctes(*LABELS)} select segment_id, frame_idx, row_number() over (order by segment_id, frame_idx) as annotation_id from good",
        "coco_nest": f"{ctes(*LABELS)} select case when segment_id = 'VID001_B' then 'train' else 'val' end as split, cast(count(*) as integer) as n_images, cast(count(*) as integer) as n_annotations, min(frame_idx) as first_image from good where frame_idx % 5 <> 0 group by all",
        "split_holdout": f"{ctes(*LABELS)} select case when segment_id = 'VID001_B' then 'train' else 'val' end as split, count(*) as rows, count(distinct frame_idx) as images from good group by all",
        "split_by_case": f"{ctes(TRACKS)}, m(case_id, split) as (values {cases}) select coalesce(split, 'train') as split, count(distinct case_id) as cases, count(*) as rows from tracks left join m using (case_id) group by all",
        "split_disjoint": f"{ctes(TRACKS)}, t as (select case_id, case when case_id = 'C9' then case when frame_idx % 2 = 0 then 'test' else 'val' end when case_id = 'C8' then 'val' else 'train' end as split from tracks), n as (select case_id, count(distinct split) as k from t group by 1) select split, string_agg(distinct case_id, ',' order by case_id) as cases, max(k) = 1 as independent from t join n using (case_id) group by split",
        "even_sample": f"{ctes(TRACKS)}, n as (select segment_id, frame_idx, row_number() over (partition by segment_id order by frame_idx) - 1 as i, count(*) over (partition by segment_id) as n from tracks) select segment_id, frame_idx from n where i in (select j * (n.n - 1) // greatest(least(4, n.n) - 1, 1) from range(0, 4) x(j) where j < least(4, n.n))",
        "box_shape": f"{ctes(*LABELS, SHAPE)} select segment_id, frame_idx, {rd('box_area_norm')}, {rd('aspect_ratio')}, {rd('boundary_margin')} from shape",
        "position_speed": f"{ctes(*LABELS, SHAPE, SPEED)} select segment_id, frame_idx, {rd('position_speed')} from speed",
        "robust_z": f"{ctes(*SCORES)} select segment_id, frame_idx, {rd('area_z')}, {rd('aspect_z')}, {rd('speed_z')} from z3",
        "anomaly_topk": f"{ctes(*SCORES)}, l as ({' union all '.join(f"select segment_id, frame_idx, '{n}' as reason, {c} as v, {sign} * {c} as o from z3" for n, c, sign in _REASONS)}) select segment_id, frame_idx, reason, {rd('v', 'reason_score')}, cast(rank as integer) as rank from (select *, row_number() over (partition by segment_id, reason order by round(o, 9), frame_idx) as rank from l where o is not null) a where rank <= 4",
        "image_stats": IMAGE,
        "registry_upsert": "select s_name as name, case when s_suppkey % 3 = 0 then s_suppkey + 1000.0::double else s_suppkey::double end as map from supplier union all values ('fresh', 1.0::double)",
        "best_experiment": "select s_name as name, (s_suppkey % 7)::double as map, (s_suppkey % 5)::double as map_75 from supplier where s_suppkey % 4 <> 0 order by s_suppkey % 7 desc, s_suppkey % 5 desc, s_suppkey limit 1",
        "best_epoch": "select user_id as run_id, event_id as epoch, round(value, 1) as map, cast(props->>'k' as double) as map_75 from events qualify row_number() over (partition by user_id order by round(value, 1) desc, cast(props->>'k' as double) desc, event_id) = 1",
        "early_stop": "with e as (select user_id as run_id, event_id as epoch, round(value, 2) as v from events), b as (select *, coalesce(v > max(v) over (partition by run_id order by epoch rows between unbounded preceding and 1 preceding), true) as better from e), l as (select *, epoch - max(case when better then epoch end) over (partition by run_id order by epoch) as stale from b) select run_id, epoch, stale, stale >= 5 as stops from l",
        "quality_gate": "select p_partkey, p_size / 50.0::double >= 0.5::double and coalesce(case when p_partkey % 5 <> 0 then (p_partkey % 10) / 10.0::double end, 0) >= 0.25::double as passes from part",
    }

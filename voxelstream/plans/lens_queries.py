"""Queries of the engine's operators over the driver's tables, each with its SQL for DuckDB.

``_query`` registers a function under its name, with the SQL that must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import round6
from ..operators import control, exposure, register, ring, stats, tiles, track
from ..sources import frames as fr
from ..sources import lens, sinks, store
from ..sources.lens import N_Z, SIDE, table
from ..sources.shared import shared_path, stored
from ..streaming import assemble, positions
from . import expand
from .config import checked

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The views of ``sources.lens`` in SQL.
FRAMES_SQL = """frames as (
    select p, c, seq, v, rn // 4 as t, rn % 4 as z
    from (select user_id as p, event_type as c, event_id as seq, value as v,
                 row_number() over (partition by user_id, event_type order by event_id) - 1 as rn from events))"""
VOLUMES_SQL = """volumes as (
    select vec_id, cast(label as bigint) as p, row_number() over (partition by label order by vec_id) - 1 as t, embedding from embeddings),
voxels as (
    select vec_id, p, t, i // 16 as z, (i // 4) % 4 as y, i % 4 as x, v
    from (select vec_id, p, t, cast(unnest(embedding) as double) as v, generate_subscripts(embedding, 1) - 1 as i from volumes))"""


def _query(sql: str | None = None):
    def register_it(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register_it


def r6(expression: str) -> str:
    """SQL of ``round6``; adding zero turns -0.0 into 0.0."""
    return f"round(cast({expression} as double), 6) + 0.0"


# --- plans -----------------------------------------------------------------------------------------------


@_query("""
    select (((t * (select count(*) from nation) + p) * 2 + c) * 13 + z) as seq, t, p, c, z
    from range(3) a(t), range((select count(*) from nation)) b(p), range(2) d(c), range(13) e(z)""")
def plan_expand(spark, sf_dir):
    return expand.expand(spark, {"t": 3, "p": table(spark, sf_dir, "nation").count(), "c": 2, "z": 13}, "tpcz")


@_query("""
    with n as (select p_partkey, -p_size as z0, cast(ceil((p_size + 3.5e0 + p_size) / 3.5e0) as bigint) as n from part)
    select p_partkey, z, z0 + z * 3.5e0 as z_um from (select p_partkey, z0, unnest(range(n)) as z from n)""")
def zplan_overshoot(spark, sf_dir):
    plans = table(spark, sf_dir, "part").select("p_partkey", (-F.col("p_size")).alias("z0"), F.col("p_size").alias("z1"), F.lit(3.5).alias("step"))
    return expand.z_slices(plans, "z0", "z1", "step").select("p_partkey", "z", "z_um")


@_query("""
    select c_custkey, case when (select bool_and(len(string_split(c_name, '-Site_')) = 2) from customer) then string_split(c_name, '-Site_')[1]
        when (select bool_and(len(string_split(c_name, '-Pos')) = 2) from customer) then string_split(c_name, '-Pos')[1] else '0' end as well,
        case when (select bool_and(len(string_split(replace(c_name, '#', '-Site_'), '-Site_')) = 2) from customer) then string_split(c_name, '#')[1] else '0' end as well_marked
    from customer""")
def well_parse(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    plain = expand.well_ids(names, "c_name")
    marked = expand.well_ids(names.select("c_custkey", F.replace("c_name", F.lit("#"), F.lit("-Site_")).alias("label")), "label")
    return plain.join(marked.select("c_custkey", F.col("well").alias("well_marked")), "c_custkey").select("c_custkey", "well", "well_marked")


FAILS = [(1, 0), (None, 1), (2, None)]


@_query(f"""with {FRAMES_SQL}, fails(t, p) as (values (1, 0), (null, 1), (2, null))
    select p, c, seq, t, z from frames e where exists (select 1 from fails f where (f.t is null or f.t = e.t) and (f.p is null or f.p = e.p))""")
def fail_at_index(spark, sf_dir):
    return expand.failing(lens.frames(spark, sf_dir), spark.createDataFrame(FAILS, "t long, p long"), ["t", "p"]).select("p", "c", "seq", "t", "z")


@_query("""
    with e as (select event_id, event_type, cast(json_extract_string(props, '$.k') as int) as k from events)
    select event_id, case when k % 2 = 0 then 'Stage=' || event_type || ',Z=' || k || ',Laser=on' else 'Stage=' || event_type || ',Laser=on,Z=' || k end as properties from e""")
def property_upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    one = lambda d, v: F.struct(F.lit(d).alias("device"), F.lit("Position").alias("property"), v.cast("string").alias("value"))
    stage, laser = one("Stage", F.col("event_type")), one("Laser", F.lit("on"))
    held = F.when(F.col("k") % 2 == 0, F.array(stage, one("Z", F.lit("old")), laser)).otherwise(F.array(stage, laser))
    new = expand.upsert_property(held, "Z", "Position", F.col("k"))
    return events.select("event_id", F.array_join(F.transform(new, lambda p: F.concat(p["device"], F.lit("="), p["value"])), ",").alias("properties"))


@_query("""
    select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(cast(json_extract_string(props, '$.scale') as double), 1.0) as scale from events""")
def props_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(F.get_json_object("props", "$.scale").cast("double"), F.lit(1.0)).alias("scale"))


# --- frames ----------------------------------------------------------------------------------------------


@_query(f"with {FRAMES_SQL} select p, seq, t, z, v from frames where c = 'click'")
def channel_filter(spark, sf_dir):
    return lens.frames(spark, sf_dir).where("c = 'click'").select("p", "seq", "t", "z", "v")


STACKS_SQL = f"""with {FRAMES_SQL} select p, c, t as stack, count(*) as n from frames group by p, c, t having count(*) """


@_query(STACKS_SQL + ">= 4")
def stack_complete(spark, sf_dir):
    return fr.assemble(lens.frames(spark, sf_dir), ["p", "c"], "seq", N_Z).where("complete").select("p", "c", "stack", "n")


@_query(STACKS_SQL + "< 4")
def stack_partial(spark, sf_dir):
    return fr.assemble(lens.frames(spark, sf_dir), ["p", "c"], "seq", N_Z).where("not complete").select("p", "c", "stack", "n")


@_query(f"with {FRAMES_SQL} select p, c, t as stack, string_agg(cast(seq as varchar), ',' order by seq) as arrivals from frames group by p, c, t")
def stack_arrival_order(spark, sf_dir):
    stacks = fr.assemble(lens.frames(spark, sf_dir), ["p", "c"], "seq", N_Z)
    return stacks.select("p", "c", "stack", F.array_join(F.col("arrivals").cast("array<string>"), ",").alias("arrivals"))


@_query(f"with {FRAMES_SQL} select p, t, arg_min(v, seq) as v, min(seq) as seq from frames group by p, t")
def baseline_first(spark, sf_dir):
    return track.first_wins(lens.frames(spark, sf_dir), ["p", "t"], "seq").select("p", "t", "v", "seq")


@_query("""
    with r as (select event_id, event_id - 500 as t, user_id % 5 as c, event_id * 7 - 3000 as z from events)
    select event_id, ((t % 3) + 3) % 3 * 10000 + c % 2 * 1000 + ((z % 10) + 10) % 10 as value from r""")
def replay_wrap(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") - 500).alias("t"), (F.col("user_id") % 5).alias("c"), (F.col("event_id") * 7 - 3000).alias("z"))
    stored = expand.expand(spark, {"t": 3, "c": 2, "z": 10}, "tcz").select("t", "c", "z", (F.col("t") * 10000 + F.col("c") * 1000 + F.col("z")).alias("value"))
    return fr.replay(requests, stored, {"t": 3, "c": 2, "z": 10}).select("event_id", "value")


@_query("""select s_suppkey, greatest(0, least(9, 5 + cast(round_even((s_acctbal - 5000) / 750e0, 0) as bigint))) as z, cast(5 as bigint) as z_unscaled from supplier""")
def replay_zindex(spark, sf_dir):
    z = lambda scale: scalars.z_index(F.col("s_acctbal"), F.lit(5000.0), F.lit(scale), F.lit(10))
    return table(spark, sf_dir, "supplier").select("s_suppkey", z(750.0).alias("z"), z(0.0).alias("z_unscaled"))


@_query("""
    select event_id, cast(case event_type when 'click' then 0 when 'view' then 1 else -1 end as bigint) as c,
        case event_type when 'click' then (event_id % 3) * 10000 when 'view' then (event_id % 3) * 10000 + 1000 else 0 end as value from events""")
def replay_unknown_channel(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("t"), F.col("event_type").alias("channel"))
    stored = expand.expand(spark, {"t": 3, "c": 2}, "tc").withColumn("channel", F.when(F.col("c") == 0, "click").otherwise("view"))
    stored = stored.select("t", "channel", F.col("c").alias("found"), (F.col("t") * 10000 + F.col("c") * 1000).alias("value"))
    return fr.replay(requests, stored, {"t": 3}).select("event_id", F.coalesce("found", F.lit(-1).cast("long")).alias("c"), "value")


@_query(f"""with {FRAMES_SQL}, seen as (select p, t, z, sum(v) as v from frames where c = 'click' and p % 3 <> 0 group by p, t, z),
    grid as (select distinct f.p, f.t, z.z from frames f, range(4) z(z) where f.c = 'click')
    select g.p, g.t, g.z, {r6("coalesce(s.v, 0)")} as v from grid g left join seen s using (p, t, z)""")
def skip_zero_pad(spark, sf_dir):
    clicks = lens.frames(spark, sf_dir).where("c = 'click'")
    grid = clicks.select("p", "t").distinct().withColumn("z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_Z - 1).cast("long"))))
    return fr.zero_padded(grid, clicks.where("p % 3 <> 0"), ["p", "t", "z"], "v").withColumn("v", round6(F.col("v")))


@_query("""
    with l as (select conv_id, turn, text, regexp_extract(text, '(?s)([A-Za-z]+)\\.\\s*$', 1) as found from conversations)
    select conv_id, arg_max(found, turn) as found from l where found <> '' group by conv_id""")
def log_last_match(spark, sf_dir):
    return fr.last_logged(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", r"(?s)([A-Za-z]+)\.\s*$")


@_query("""
    with w as (select l_returnflag as row, sum(case when l_linestatus = 'F' then 1 else 0 end) as f, sum(case when l_linestatus = 'O' then 1 else 0 end) as o from lineitem group by 1)
    select row, col, cast(sample as bigint) as sample from (select row, 'F' as col, f as sample from w union all select row, 'O', o from w)""")
def platemap_unpivot(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("row")).pivot("l_linestatus", ["F", "O"]).count().na.fill(0)
    return fr.unpivot(wide, "row", "col", "sample")


# --- statistics ------------------------------------------------------------------------------------------


@_query(f"""with {FRAMES_SQL}, med as (select c, p, median(v) as med from frames group by c, p), mm as (select c, avg(med) as mm from med group by c)
    select seq, {r6("case when med = 0 then null else v / med * mm end")} as flat from frames join med using (c, p) join mm using (c)""")
def flatfield_median(spark, sf_dir):
    return stats.flatfield(lens.frames(spark, sf_dir), ["c"], ["p"], "v").select("seq", round6(F.col("flat")).alias("flat"))


@_query(f"with {VOLUMES_SQL} select vec_id, y, x, max(v) as v_max, bool_or(v > 0.1) as v_any from voxels group by vec_id, y, x")
def mip_any(spark, sf_dir):
    return stats.projections(lens.voxels(spark, sf_dir), ["vec_id"], "v", 0.1)


def _normalized(how: str, sql: str):
    def query(spark, sf_dir):
        return stats.normalize(lens.frames(spark, sf_dir), ["c"], "v", how).select("seq", round6(F.col("norm")).alias("norm"))

    query.__name__ = f"{how}_norm"
    _query(f"with {FRAMES_SQL}, {sql}")(query)


_normalized("minmax", f"s as (select c, min(v) as a, max(v) as b from frames group by c) select seq, {r6('(v - a) / (b - a + 1e-8)')} as norm from frames join s using (c)")
_normalized("symmetric", f"s as (select c, min(v) as a, max(v) as b from frames group by c) select seq, {r6('(v - a) / (b - a + 1e-8) * 2 - 1')} as norm from frames join s using (c)")
_normalized("zscore", f"s as (select c, avg(v) as a, stddev_samp(v) as b from frames group by c) select seq, {r6('(v - a) / (b + 1e-8)')} as norm from frames join s using (c)")
_normalized(
    "iqr",
    f"""q as (select c, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from frames group by c),
    k as (select c, seq, greatest(q1 - 1.5e0 * (q3 - q1), least(q3 + 1.5e0 * (q3 - q1), v)) as v from frames join q using (c)),
    s as (select c, avg(v) as a, stddev_samp(v) as b from k group by c) select seq, {r6('(v - a) / (b + 1e-8)')} as norm from k join s using (c)""",
)

HISTOGRAM_SQL = """bounds as (select {k}, min(v) as lo, max(v) as hi from {t} group by {k}),
    h as (select {k}, lo, hi, cast(case when lo = hi then 0 else least(floor((v - lo) / (hi - lo) * 256), 255) end as bigint) as bin, count(*) as n
          from {t} join bounds using ({k}) group by all)"""


@_query(f"with {FRAMES_SQL}, {HISTOGRAM_SQL.format(k='c', t='frames')} select c, bin, n from h")
def hist256(spark, sf_dir):
    return stats.histogram(lens.frames(spark, sf_dir), ["c"], "v").select("c", "bin", "n")


@_query(f"""with {FRAMES_SQL}, {HISTOGRAM_SQL.format(k='c', t='frames')},
    s as (select *, sum(n) over (partition by c order by bin) / sum(n) over (partition by c) as share from h)
    select c, {r6("case when min(lo) = min(hi) then min(lo) else min(lo) + (min(bin) + 1) * (min(hi) - min(lo)) / 256 end")} as percentile from s where share >= 0.9 group by c""")
def percentile_hist(spark, sf_dir):
    return stats.percentile_by_histogram(lens.frames(spark, sf_dir), ["c"], "v", 90.0).select("c", round6(F.col("percentile")).alias("percentile"))


@_query(f"""with {FRAMES_SQL}, {HISTOGRAM_SQL.format(k='c', t='frames')},
    g as (select b.c, b.lo, b.hi, i.bin, cast(coalesce(h.n, 0) as double) as n from bounds b cross join range(256) i(bin) left join h on h.c = b.c and h.bin = i.bin),
    p as (select c, lo, hi, bin, n / sum(n) over (partition by c) as p, lo + bin * ((hi - lo) / 255) as centre from g),
    s as (select c, lo, hi, bin, sum(p) over (partition by c order by bin) as w, sum(p * centre) over (partition by c order by bin) as m, sum(p * centre) over (partition by c) as mu from p),
    pairs as (select a.c, a.lo, a.hi, a.bin as a, b.bin as b, a.w as w0, b.w - a.w as w1, 1.0e0 - b.w as w2, a.m as m0, b.m - a.m as m1, a.mu - b.m as m2, a.mu from s a join s b on a.c = b.c and a.bin < b.bin and b.bin <= 254),
    r as (select *, row_number() over (partition by c order by round(w0 * pow(m0 / w0 - mu, 2) + w1 * pow(m1 / w1 - mu, 2) + w2 * pow(m2 / w2 - mu, 2), 9) desc, a, b) as k
          from pairs where w0 > 1e-10 and w1 > 1e-10 and w2 > 1e-10)
    select c, a, b, {r6("lo + (a + 1) * ((hi - lo) / 255)")} as low, {r6("lo + (b + 1) * ((hi - lo) / 255)")} as high from r where k = 1""")
def otsu3(spark, sf_dir):
    return stats.otsu_thresholds(lens.frames(spark, sf_dir), ["c"], "v").select("c", "a", "b", round6(F.col("low")).alias("low"), round6(F.col("high")).alias("high"))


@_query(f"with {VOLUMES_SQL} select vec_id, " + ", ".join(f"{r6(f'coalesce(avg({a}) filter (where v > 0.15), 0)')} as c_{a}" for a in "zyx") + " from voxels group by vec_id")
def mask_centroid(spark, sf_dir):
    found = stats.mask_centroid(lens.voxels(spark, sf_dir), ["vec_id"], F.col("v") > 0.15)
    return found.select("vec_id", *[round6(F.col(f"c_{a}")).alias(f"c_{a}") for a in "zyx"])


def _centre(axis: str, name: str = "c", background: str = "0") -> str:
    w = f"greatest(v - {background}, 0)"
    back = " - 1.5" if name == "d" else ""
    return f"{r6(f'case when sum({w}) > 0 then sum({w} * {axis}) / nullif(sum({w}), 0) else 1.5 end{back}')} as {name}_{axis}"


@_query(f"with {VOLUMES_SQL} select vec_id, " + ", ".join(_centre(a) for a in "zyx") + " from voxels group by vec_id")
def intensity_com(spark, sf_dir):
    found = stats.intensity_centroid(lens.voxels(spark, sf_dir), ["vec_id"], F.col("v"))
    return found.select("vec_id", *[round6(F.col(f"c_{a}")).alias(f"c_{a}") for a in "zyx"])


BACKGROUND_SQL = f"""{HISTOGRAM_SQL.format(k='vec_id', t='voxels')},
    s as (select *, sum(n) over (partition by vec_id order by bin) / sum(n) over (partition by vec_id) as share from h),
    bg as (select vec_id, case when min(lo) = min(hi) then min(lo) else min(lo) + (min(bin) + 1) * (min(hi) - min(lo)) / 256 end as bg from s where share >= 0.5 group by vec_id)"""


@_query(f"with {VOLUMES_SQL}, {BACKGROUND_SQL} select vec_id, " + ", ".join(_centre(a, background="bg") for a in "zyx") + " from voxels join bg using (vec_id) group by vec_id")
def intensity_com_bg(spark, sf_dir):
    v = lens.voxels(spark, sf_dir)
    background = stats.percentile_by_histogram(v, ["vec_id"], "v", 50.0)
    found = stats.intensity_centroid(v.join(background, "vec_id"), ["vec_id"], F.col("v"), F.col("percentile"))
    return found.select("vec_id", *[round6(F.col(f"c_{a}")).alias(f"c_{a}") for a in "zyx"])


@_query(f"with {VOLUMES_SQL} select vec_id, " + ", ".join(_centre(a, "d") for a in "zyx") + " from voxels group by vec_id")
def roi_shift(spark, sf_dir):
    found = stats.intensity_centroid(lens.voxels(spark, sf_dir), ["vec_id"], F.col("v"))
    return found.select("vec_id", *[round6(F.col(f"d_{a}")).alias(f"d_{a}") for a in "zyx"])


@_query(f"with {FRAMES_SQL} select c, {r6('regr_slope(v, seq)')} as slope, {r6('regr_intercept(v, seq)')} as intercept from frames group by c")
def slope_fit(spark, sf_dir):
    return stats.slope(lens.frames(spark, sf_dir), ["c"], "seq", "v").select("c", round6(F.col("slope")).alias("slope"), round6(F.col("intercept")).alias("intercept"))


@_query(f"""with {FRAMES_SQL}, r as (select c, p, stddev_pop(v) as s from frames group by c, p),
    m as (select c, p, round(avg(s) over w, 9) as a, count(*) over w as n from r window w as (partition by c order by p rows between current row and 4 following))
    select c, p as peak from (select *, row_number() over (partition by c order by a desc, p) as k from m where n = 5) where k = 1""")
def std_peak(spark, sf_dir):
    return stats.std_peak(lens.frames(spark, sf_dir), ["c"], "p", "v")


# --- exposure and control --------------------------------------------------------------------------------

HOT_SQL = "quantile_cont(v, 0.9999)"


@_query(f"""with {FRAMES_SQL}, s as (select p, c, avg(v) as m, stddev_pop(v) as s, {HOT_SQL} as hot from frames group by p, c)
    select p, c, case when m + s > 255 * (1 - 55e0 / 100) or hot >= 255 then 1 when m - s < 255 * 5e0 / 100 then -1 else 0 end as flag from s""")
def exposure_mean(spark, sf_dir):
    return exposure.by_mean(lens.frames(spark, sf_dir), ["p", "c"], "v", 255.0, 55.0, 5.0)


@_query(f"""with {FRAMES_SQL}, h as (select p, c, {HOT_SQL} as hot from frames group by p, c),
    k as (select p, c, hot, case when v < hot then v else 0 end as v from frames join h using (p, c)),
    s as (select p, c, hot, avg(v) as m, greatest(quantile_cont(v, 0.001), 255 * 5e0 / 100) as u, least(quantile_cont(v, 0.95), 255 * (1 - 55e0 / 100)) as o from k group by p, c, hot)
    select p, c, case when m < u or m < 255 * 5e0 / 100 then -1 when m > o or hot >= 255 then 1 else 0 end as flag from s""")
def exposure_masked(spark, sf_dir):
    return exposure.by_masked_mean(lens.frames(spark, sf_dir), ["p", "c"], "v", 255.0, 55.0, 5.0)


@_query(f"""with {FRAMES_SQL}, s as (select p, c, {HOT_SQL} as hot from frames group by p, c)
    select p, c, case when hot > 255 * (1 - 55e0 / 100) or hot >= 255 then 1 when 255 * 35e0 / 100 / hot > 1 then -1 else 0 end as flag from s""")
def exposure_percentile(spark, sf_dir):
    return exposure.by_percentile(lens.frames(spark, sf_dir), ["p", "c"], "v", 255.0, 55.0, 35.0)


ILLUMINATION = [("BUILDING", 50.0, 10.0), ("MACHINERY", 25.0, 7.5)]


@_query("""
    with i(well_id, e, w) as (values ('BUILDING', 50.0e0, 10.0e0), ('MACHINERY', 25.0e0, 7.5e0))
    select c_custkey, coalesce(e, 100.0e0) as exposure, coalesce(w, 5.0e0) as power, case when e is null then null else 0 end as flag from customer left join i on well_id = c_mktsegment""")
def illumination_lookup(spark, sf_dir):
    wells = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("well_id"), F.lit(100.0).alias("exposure"), F.lit(5.0).alias("power"))
    rows = spark.createDataFrame(ILLUMINATION, "well_id string, exposure_time_ms double, laser_power_mW double")
    return exposure.manual(wells, rows, "exposure", "power").select("c_custkey", "exposure", "power", "flag")


@_query("""
    with m as (select c_nationkey, c_custkey, c_acctbal - lag(c_acctbal) over w as dx, 10.0e0 * (c_custkey - lag(c_custkey) over w) as dy from customer window w as (partition by c_nationkey order by c_custkey)),
    s as (select *, case when sqrt(dx * dx + dy * dy) < 1 then null when sqrt(dx * dx + dy * dy) < 2000 then 2.0e0 when dx is not null then 5.75e0 end as speed from m),
    b as (select *, last_value(speed ignore nulls) over (partition by c_nationkey order by c_custkey rows between unbounded preceding and 1 preceding) as before from s)
    select c_custkey, speed, speed is not null and speed is distinct from before as change from b""")
def stage_speed(spark, sf_dir):
    moves = table(spark, sf_dir, "customer").withColumn("y", F.col("c_custkey") * 10.0)
    return control.stage_speed(moves, ["c_nationkey"], "c_custkey", "c_acctbal", "y").select("c_custkey", "speed", "change")


@_query(f"""
    with r as (select l_orderkey, l_quantity as nz, 1000.0e0 / (l_discount * 100 + 1.5e0 + 0.05e0) as ls, least(1000.0e0 / (l_discount * 100 + 1.5e0), floor(l_tax * 1000 + 20)) as lf from lineitem)
    select l_orderkey, {r6("sum(nz / ls) + 0.2e0 * (count(*) - 1)")} as light_sheet, {r6("sum(nz / lf) + 0.02e0 * (count(*) - 1)")} as label_free,
        cast(ceil(greatest(round(sum(nz / ls) + 0.2e0 * (count(*) - 1), 6), round(sum(nz / lf) + 0.02e0 * (count(*) - 1), 6))) as bigint) as seconds from r group by l_orderkey""")
def acq_time(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    exposure_ms = F.col("l_discount") * 100
    sheet = control.scan_seconds(F.col("l_quantity"), control.light_sheet_rate(exposure_ms, F.lit(1.5)), 0.2)
    free = control.scan_seconds(F.col("l_quantity"), control.label_free_rate(exposure_ms, F.col("l_tax") * 1000 + 20), 0.02)
    both = items.groupBy("l_orderkey").agg(round6(sheet).alias("light_sheet"), round6(free).alias("label_free"))
    return both.withColumn("seconds", F.ceil(F.greatest("light_sheet", "label_free")).cast("long"))


@_query(f"""with {FRAMES_SQL}, s as (select p, case when v > 200 and p % 4 <> 1 then cast(z * 5 as int) end as focus, cast(seq % 3 + (p % 3) * 8 as int) as peak from frames)
    select p, cast(floor(median(focus)) as int) as focus_index, median(focus) is null and bool_and(peak < 0.2e0 * 18) as scan_left, median(focus) is null and bool_and(peak > 0.8e0 * 18) as scan_right from s group by p""")
def refocus_decision(spark, sf_dir):
    rows = lens.frames(spark, sf_dir)
    focus = F.when((F.col("v") > 200) & (F.col("p") % 4 != 1), (F.col("z") * 5).cast("int"))
    found = rows.select("p", focus.alias("focus"), (F.col("seq") % 3 + (F.col("p") % 3) * 8).cast("int").alias("peak"))
    return control.refocus(found, ["p"], "focus", "peak", 19)


@_query("select event_id, event_type is distinct from lag(event_type) over (partition by user_id order by event_id) as changed from events")
def change_detection(spark, sf_dir):
    return control.changes(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("event_id", "changed")


@_query("""
    select cast((select count(*) from (select distinct c_nationkey as k from customer where c_acctbal > 9000 except select distinct s_nationkey from supplier)) as bigint) as only_left,
           cast((select count(*) from (select distinct s_nationkey as k from supplier except select distinct c_nationkey from customer where c_acctbal > 9000)) as bigint) as only_right""")
def well_set_equality(spark, sf_dir):
    wells = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return control.same_set(wells, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@_query("""
    with used as (select distinct cast(p_size as bigint) as i from part where p_size % 7 <> 0)
    select min(i) as first_free from (select i + 1 as i from used union all select 1) where i not in (select i from used)""")
def unique_name_gap(spark, sf_dir):
    return sinks.first_free(table(spark, sf_dir, "part").where("p_size % 7 <> 0"), "p_size")


@_query("""
    select p_partkey, case when contains(lower(p_name), 'red') then 'red' when contains(lower(p_name), 'green') then 'green' when contains(lower(p_name), 'blue') then 'blue' else 'gray' end as colormap,
        case when regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') = '' then 'p' || p_partkey else regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') end as folder from part""")
def display_names(spark, sf_dir):
    colour = scalars.first_match(F.col("p_name"), [(c, c) for c in ("red", "green", "blue")], "gray")
    return table(spark, sf_dir, "part").select("p_partkey", colour.alias("colormap"), sinks.folder_name(F.col("p_name"), F.col("p_partkey")).alias("folder"))


@_query("""select event_id, case event_id % 160 when 32 then 488 when 64 then 561 when 128 then 639 end as wavelength from events""")
def laser_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", control.laser((F.col("event_id") % 160).cast("int")).alias("wavelength"))


@_query(f"select s_suppkey, {r6('s_acctbal - lag(s_acctbal, 1, 0) over (partition by s_nationkey order by s_suppkey)')} as step from supplier")
def z_steps(spark, sf_dir):
    return control.z_steps(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey", "s_acctbal").select("s_suppkey", round6(F.col("step")).alias("step"))


@_query(f"""with {FRAMES_SQL}, o as (select c, p, t, v, min((p, t)) over (partition by c) as first from frames)
    select c, min(v) as low, max(v) as high from o where (p, t) = first group by c having min(v) < max(v)""")
def contrast_first_frame(spark, sf_dir):
    return control.first_contrast(lens.frames(spark, sf_dir), ["c"], ["p", "t"], "v")


@_query(f"""with {FRAMES_SQL}, s as (select c, case when p % 2 = 0 then 1 else -1 end as d, p, regr_slope(v, seq) as s from frames group by c, d, p)
    select c, round(avg(s) filter (where d = 1) / nullif(avg(s) filter (where d = -1), 0), 3) as factor from s group by c""")
def slope_compensation(spark, sf_dir):
    points = lens.frames(spark, sf_dir).withColumn("d", F.when(F.col("p") % 2 == 0, 1).otherwise(-1))
    return control.compensation(points, ["c"], "d", "p", "seq", "v").select("c", F.round("factor", 3).alias("factor"))


# --- tracking --------------------------------------------------------------------------------------------

INTERVAL = 4
ASOF_SQL = """a as (select *, row_number() over (partition by p order by t) = 1 or t % 4 = 0 as anchor from volumes),
    o as (select *, last_value(case when anchor then vec_id end ignore nulls) over (partition by p order by t rows between unbounded preceding and current row) as reference from a)"""


def _referenced(spark, sf_dir) -> DataFrame:
    return track.as_of_reference(lens.volumes(spark, sf_dir), ["p"], "t", "vec_id", INTERVAL)


@_query(f"with {VOLUMES_SQL}, {ASOF_SQL} select vec_id, p, t, anchor, reference, not anchor and t % 2 = 0 as tracked from o")
def asof_reference(spark, sf_dir):
    return _referenced(spark, sf_dir).select("vec_id", "p", "t", "anchor", "reference", track.tracked(F.col("anchor"), F.col("t"), 2).alias("tracked"))


@_query(f"""with {VOLUMES_SQL}, {ASOF_SQL},
    f as (select vec_id, i, cast(embedding[i + 1] as double) as v from volumes, range(64) r(i)),
    k as (select o.vec_id, m.i as j, r.i as i, m.v as mv, r.v as rv from o join f m on m.vec_id = o.vec_id join f r on r.vec_id = o.reference),
    s as (select vec_id, (j - i + 64) % 64 as lag, round(abs(sum(mv * rv)), 9) as corr from k group by 1, 2),
    w as (select vec_id, lag, corr, (lag + 32) % 64 as shifted from s),
    b as (select vec_id, lag, row_number() over (partition by vec_id order by corr desc, (64 - lag + 32) % 64) as k from s)
    select vec_id, cast(case when lag <= 32 then lag else lag - 64 end as double) as shift from b where k = 1""")
def xcorr_shift_1d(spark, sf_dir):
    return _shifts(spark, sf_dir, (64,), "pcc").select("vec_id", F.col("shift")[0].alias("shift"))


def _shifts(spark, sf_dir, shape: tuple[int, ...], method: str) -> DataFrame:
    rows = _referenced(spark, sf_dir)
    references = rows.select(F.col("vec_id").alias("reference"), F.col("voxels").alias("ref_voxels"))
    pairs = rows.join(references, "reference")
    return pairs.select("vec_id", "p", "t", "anchor", register.pixel_shift(method, F.col("ref_voxels"), F.col("voxels"), shape).alias("shift"))


@_query(f"""with {VOLUMES_SQL}, {ASOF_SQL},
    k as (select o.vec_id, m.z as mz, m.y as my, m.x as mx, r.z as rz, r.y as ry, r.x as rx, m.v as mv, r.v as rv from o join voxels m on m.vec_id = o.vec_id join voxels r on r.vec_id = o.reference),
    s as (select vec_id, (mz - rz + 4) % 4 as dz, (my - ry + 4) % 4 as dy, (mx - rx + 4) % 4 as dx, round(abs(sum(mv * rv)), 9) as corr from k group by 1, 2, 3, 4),
    b as (select *, row_number() over (partition by vec_id order by corr desc, (6 - dz) % 4, (6 - dy) % 4, (6 - dx) % 4) as k from s)
    select vec_id, cast(case when dz <= 2 then dz else dz - 4 end as double) as dz, cast(case when dy <= 2 then dy else dy - 4 end as double) as dy,
        cast(case when dx <= 2 then dx else dx - 4 end as double) as dx from b where k = 1""")
def xcorr_shift_3d(spark, sf_dir):
    return _shifts(spark, sf_dir, (SIDE,) * 3, "pcc").select("vec_id", *[F.col("shift")[i].alias(f"d{a}") for i, a in enumerate("zyx")])


def _blur_sql(axis: str, source: str) -> str:
    """One axis of a blur by the weights ``gauss`` (d, w), borders reflected (0 1 2 3 -> 1, 2 and 3 before, 2, 1 and 0 beyond)."""
    others = ", ".join(a for a in "zyx" if a != axis)
    return f"""(select k.vec_id, {others}, o.i as {axis}, sum(k.v * g.w) as v from {source} k
        join (select i, d, w, case when i + d < 0 then -(i + d) when i + d > 3 then 6 - (i + d) else i + d end as src from range(4) a(i), gauss) g on g.src = k.{axis}
        join range(4) o(i) on o.i = g.i group by k.vec_id, {others}, o.i)"""


#: Masks of volumes: rescaled, blurred with sigma 5 (cut to the volume), above the first of two Otsu thresholds.
MASK_SQL = f"""{VOLUMES_SQL}, {{asof}}, ends as (select vec_id, min(v) as lo, max(v) as hi from voxels group by vec_id),
    unit as (select vec_id, z, y, x, (v - lo) / (hi - lo) as v from voxels join ends using (vec_id)),
    raw as (select d, exp(-0.5e0 * pow(d / 5.0e0, 2)) as w from range(-3, 4) r(d)), gauss as (select d, w / (select sum(w) from raw) as w from raw),
    bz as {_blur_sql("z", "unit")}, b_y as {_blur_sql("y", "bz")}, soft as {_blur_sql("x", "b_y")},
    span as (select vec_id, min(v) as lo, max(v) as hi from soft group by vec_id),
    h as (select vec_id, least(floor((v - lo) / (hi - lo) * 256), 255) as bin, count(*) / 64.0e0 as p from soft join span using (vec_id) group by 1, 2),
    cut as (select s.vec_id, k.k, coalesce(sum(h.p), 0) as w, coalesce(sum(h.p * h.bin / 255), 0) as m from span s cross join range(1, 256) k(k) left join h on h.vec_id = s.vec_id and h.bin < k.k group by 1, 2),
    mu as (select vec_id, sum(p * bin / 255) as mu from h group by vec_id),
    best as (select a.vec_id, max((round(pow(a.m, 2) / a.w + pow(b.m - a.m, 2) / (b.w - a.w) + pow(mu - b.m, 2) / (1 - b.w) - pow(mu, 2), 9), -a.k, -b.k)) as r
             from cut a join cut b on a.vec_id = b.vec_id and a.k < b.k join mu on mu.vec_id = a.vec_id where a.w > 1e-10 and b.w - a.w > 1e-10 and 1 - b.w > 1e-10 group by a.vec_id),
    mask as (select vec_id, z, y, x, cast(v > lo - r[2] * (hi - lo) / 255 as int) as v from soft join span using (vec_id) join best using (vec_id))""".format(asof=ASOF_SQL)


@_query(f"""with {MASK_SQL},
    k as (select o.vec_id, (m.z - r.z + 4) % 4 as dz, (m.y - r.y + 4) % 4 as dy, (m.x - r.x + 4) % 4 as dx, m.v * r.v as vv from o join mask m on m.vec_id = o.vec_id join mask r on r.vec_id = o.reference),
    s as (select vec_id, dz, dy, dx, sum(vv) as corr from k group by 1, 2, 3, 4),
    b as (select *, row_number() over (partition by vec_id order by corr desc, (6 - dz) % 4, (6 - dy) % 4, (6 - dx) % 4) as k from s)
    select vec_id, cast(case when dz <= 2 then dz else dz - 4 end as double) as dz, cast(case when dy <= 2 then dy else dy - 4 end as double) as dy,
        cast(case when dx <= 2 then dx else dx - 4 end as double) as dx from b where k = 1""")
def otsu_pcc_shift(spark, sf_dir):
    return _shifts(spark, sf_dir, (SIDE,) * 3, "multiotsu_pcc").select("vec_id", *[F.col("shift")[i].alias(f"d{a}") for i, a in enumerate("zyx")])


@_query(f"""with {MASK_SQL}, c as (select vec_id, """ + ", ".join(f"coalesce(avg({a}) filter (where v = 1), 0) as c_{a}" for a in "zyx") + f""" from mask group by vec_id)
    select o.vec_id, """ + ", ".join(f"{r6(f'm.c_{a} - r.c_{a}')} as d{a}" for a in "zyx") + " from o join c m on m.vec_id = o.vec_id join c r on r.vec_id = o.reference")
def otsu_com_shift(spark, sf_dir):
    return _shifts(spark, sf_dir, (SIDE,) * 3, "multiotsu_center_of_mass").select("vec_id", *[round6(F.col("shift")[i]).alias(f"d{a}") for i, a in enumerate("zyx")])


@_query(f"""with {VOLUMES_SQL},
    r as (select z.z, y.y, x.x, exp(-0.5e0 * pow((z.z - 1.5e0) / 10, 2)) * exp(-0.5e0 * pow((y.y - 1.5e0) / 10, 2)) * exp(-0.5e0 * pow((x.x - 1.5e0) / 10, 2)) as v from range(4) z(z), range(4) y(y), range(4) x(x)),
    k as (select m.vec_id, (m.z - r.z + 4) % 4 as dz, (m.y - r.y + 4) % 4 as dy, (m.x - r.x + 4) % 4 as dx, m.v * r.v as vv from voxels m, r),
    s as (select vec_id, dz, dy, dx, round(abs(sum(vv)), 9) as corr from k group by 1, 2, 3, 4),
    b as (select *, row_number() over (partition by vec_id order by corr desc, (6 - dz) % 4, (6 - dy) % 4, (6 - dx) % 4) as k from s)
    select vec_id, cast(case when dz <= 2 then dz else dz - 4 end as double) as dz, cast(case when dy <= 2 then dy else dy - 4 end as double) as dy,
        cast(case when dx <= 2 then dx else dx - 4 end as double) as dx from b where k = 1""")
def roi_pcc_shift(spark, sf_dir):
    return _shifts(spark, sf_dir, (SIDE,) * 3, "roi_center_pcc").select("vec_id", *[F.col("shift")[i].alias(f"d{a}") for i, a in enumerate("zyx")])


@_query(f"""with {VOLUMES_SQL}, raw as (select d, exp(-0.5e0 * pow(d / 0.5e0, 2)) as w from range(-2, 3) r(d)), gauss as (select d, w / (select sum(w) from raw) as w from raw),
    bz as {_blur_sql("z", "voxels")}, b_y as {_blur_sql("y", "bz")}, bx as {_blur_sql("x", "b_y")} select vec_id, z * 16 + y * 4 + x as i, {r6("v")} as v from bx""")
def gaussian_blur(spark, sf_dir):
    rows = lens.volumes(spark, sf_dir).select("vec_id", F.posexplode(register.blurred(F.col("voxels"), (SIDE,) * 3, 0.5)).alias("i", "v"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), round6(F.col("v")).alias("v"))


LIMITS = {"z": (0.02, 0.3), "y": (0.05, 0.2), "x": (0.01, 0.25)}
DAMPENING = {"z": 0.5, "y": 0.25, "x": 0.1}
SCALE = {"z": 2.0, "y": 0.5, "x": 0.5}
MATRIX = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]

COM_SQL = "d as (select vec_id, p, t, " + ", ".join(_centre(a, "d").replace("round(cast(", "(").replace(" as double), 6) + 0.0", ")") for a in "zyx") + " from voxels group by vec_id, p, t)"
LIMIT_SQL = {a: f"case when abs(d_{a} * {SCALE[a]}e0) < {LIMITS[a][0]}e0 then 0 when abs(d_{a} * {SCALE[a]}e0) > {LIMITS[a][1]}e0 then sign(d_{a}) * {LIMITS[a][1]}e0 else d_{a} * {SCALE[a]}e0 end" for a in "zyx"}
SHIFT_SQL = f"{COM_SQL}, s as (select vec_id, p, t, " + ", ".join(f"({LIMIT_SQL[a]}) * {DAMPENING[a]}e0 as s_{a}" for a in "zyx") + " from d)"
STAGE_SQL = {"x": "-s_y", "y": "s_x", "z": "s_z"}


def _centre_shifts(spark, sf_dir) -> DataFrame:
    return stats.intensity_centroid(lens.voxels(spark, sf_dir), ["vec_id", "p", "t"], F.col("v"))


def _shift_columns(limits=None, dampening=None) -> dict:
    return track.shift_um({a: F.col(f"d_{a}") for a in "zyx"}, SCALE, limits, dampening)


@_query(f"with {VOLUMES_SQL}, {COM_SQL} select vec_id, " + ", ".join(f"{r6(LIMIT_SQL[a])} as s_{a}" for a in "zyx") + " from d")
def limit_shift(spark, sf_dir):
    return _centre_shifts(spark, sf_dir).select("vec_id", *[round6(c).alias(f"s_{a}") for a, c in _shift_columns(LIMITS).items()])


@_query(f"with {VOLUMES_SQL}, {SHIFT_SQL} select vec_id, " + ", ".join(f"{r6(f's_{a}')} as s_{a}" for a in "zyx") + " from s")
def dampen(spark, sf_dir):
    return _centre_shifts(spark, sf_dir).select("vec_id", *[round6(c).alias(f"s_{a}") for a, c in _shift_columns(LIMITS, DAMPENING).items()])


@_query(f"with {VOLUMES_SQL}, {SHIFT_SQL} select vec_id, " + ", ".join(f"{r6(STAGE_SQL[a])} as stage_{a}" for a in "xyz") + " from s")
def image_to_stage(spark, sf_dir):
    stage = track.to_stage(_shift_columns(LIMITS, DAMPENING), MATRIX)
    return _centre_shifts(spark, sf_dir).select("vec_id", *[round6(c).alias(f"stage_{a}") for a, c in stage.items()])


BASE_SQL = {"x": "100.0e0 * p", "y": "50.0e0 * p + t", "z": "case when p % 3 = 0 then null else 10.0e0 end"}


def _tracked(spark, sf_dir) -> DataFrame:
    """p, t, shift in image axes, corrected coordinates."""
    shift = _shift_columns(LIMITS, DAMPENING)
    p, t = F.col("p"), F.col("t")
    baseline = {"x": p * 100.0, "y": p * 50.0 + t, "z": F.when(p % 3 == 0, None).otherwise(10.0)}
    coordinates = track.corrected(baseline, track.to_stage(shift, MATRIX))
    return _centre_shifts(spark, sf_dir).select("p", "t", *[c.alias(f"s_{a}") for a, c in shift.items()], *[c.alias(f"stage_{a}") for a, c in coordinates.items()])


@_query(f"with {VOLUMES_SQL}, {SHIFT_SQL} select p, t, " + ", ".join(f"{r6(f'({BASE_SQL[a]}) - ({STAGE_SQL[a]})')} as stage_{a}" for a in "xyz") + " from s")
def track_positions(spark, sf_dir):
    return _tracked(spark, sf_dir).select("p", "t", *[round6(F.col(f"stage_{a}")).alias(f"stage_{a}") for a in "xyz"])


@_query(f"with {VOLUMES_SQL}, {SHIFT_SQL} select p, t, {r6('100.0e0 * p - sum(-s_y) over (partition by p order by t)')} as x from s")
def position_recurrence(spark, sf_dir):
    shifts = _centre_shifts(spark, sf_dir).select("p", "t", track.to_stage(_shift_columns(LIMITS, DAMPENING), MATRIX)["x"].alias("s"))
    return track.recurrence(shifts, ["p"], "t", F.col("p") * 100.0, F.col("s"), "x").select("p", "t", round6(F.col("x")).alias("x"))


def _text_sql(e: str) -> str:
    return f"coalesce(printf('%.4f', cast({e} as double)), '')"


@_query(f"with {VOLUMES_SQL}, {SHIFT_SQL} select p as position_index, t as timepoint_index, " + ", ".join(f"{_text_sql(f's_{a}')} as shift_{a}_um" for a in "zyx") + ", " + ", ".join(f"{_text_sql(f'({BASE_SQL[a]}) - ({STAGE_SQL[a]})')} as stage_{a}" for a in "xyz") + " from s")
def shift_log(spark, sf_dir):
    rows = _tracked(spark, sf_dir).select(F.col("p").alias("position_index"), F.col("t").alias("timepoint_index"), *[F.col(f"s_{a}").alias(f"shift_{a}_um") for a in "zyx"], *[f"stage_{a}" for a in "xyz"])
    return sinks.shift_log(rows)


# --- live view -------------------------------------------------------------------------------------------

SLOTS = 16
RANGE = 64  # arrivals that are numbered together, so that the small tables have many ranges
#: Generations of a volume: each begins at the first arrival that finds the one before overwritten.
def _ring_sql(n: int) -> str:
    return f"""recursive {FRAMES_SQL}, r as (select *, row_number() over (partition by c order by seq) - 1 as arrival from frames),
    b as (select c, p, t, min(arrival) as first from r group by c, p, t
          union all select b.c, b.p, b.t, n.arrival from b, lateral (select min(x.arrival) as arrival from r x where x.c = b.c and x.p = b.p and x.t = b.t and x.arrival >= b.first + {n}) n where n.arrival is not null),
    m as (select b.c, b.p, b.t, b.first, r.arrival, r.z from b join r on r.c = b.c and r.p = b.p and r.t = b.t and r.arrival >= b.first and r.arrival < b.first + {n}),
    k as (select c, p, t, first, z, min(arrival) as arrival from m group by c, p, t, first, z),
    g as (select b.c, b.p, b.t, b.first, (select max(m.arrival) from m where m.c = b.c and m.p = b.p and m.t = b.t and m.first = b.first) as last,
          (select case when count(*) >= 4 then max(k.arrival) end from k where k.c = b.c and k.p = b.p and k.t = b.t and k.first = b.first) as completed from b)"""


RING_SQL, WIDE_SQL = _ring_sql(16), _ring_sql(1024)


def _arrived(spark, sf_dir, n_slots: int = SLOTS) -> DataFrame:
    return ring.slots(lens.frames(spark, sf_dir), ["c"], "seq", n_slots, RANGE)


def _generations(spark, sf_dir, n_slots: int = SLOTS) -> DataFrame:
    return ring.generations(_arrived(spark, sf_dir, n_slots), ["c"], ["p", "t"], n_slots, N_Z)


@_query(f"with {FRAMES_SQL} select seq, row_number() over (partition by c order by seq) - 1 as arrival, (row_number() over (partition by c order by seq) - 1) % 16 as slot from frames")
def ring_slots(spark, sf_dir):
    return _arrived(spark, sf_dir).select("seq", "arrival", "slot")


@_query(f"with {RING_SQL}, e as (select c, max(arrival) as stop from r group by c) select c, p, t, first, last, completed is not null as complete from g join e using (c) where first + 16 > stop")
def ring_live(spark, sf_dir):
    """Volumes in the buffer at the end."""
    live = ring.live_at_end(_generations(spark, sf_dir), ["c"])
    return live.select("c", "p", "t", "first", "last", F.col("completed").isNotNull().alias("complete"))


@_query(f"with {RING_SQL} select c, p, t, last as seen from (select *, row_number() over (partition by c order by last desc) as i from g where completed is not null) where i = 1")
def follow_target(spark, sf_dir):
    return ring.follow_target(_generations(spark, sf_dir), ["c"], ["p", "t"])


@_query(f"with {WIDE_SQL} select c, p, t, last as seen from (select *, row_number() over (partition by c order by last desc) as i from g where completed is not null) where i = 1")
def follow_target_wide(spark, sf_dir):
    """In a ring that volumes of many positions fit in."""
    return ring.follow_target(_generations(spark, sf_dir, 1024), ["c"], ["p", "t"])


@_query(f"""with {FRAMES_SQL}, f as (select p, t, z, c, min(seq) as first from frames where c in ('click', 'view') group by p, t, z, c)
    select p, t, z, max(first) as seen from f group by p, t, z having count(*) = 2""")
def plane_complete(spark, sf_dir):
    """Planes that both of two channels have brought."""
    arrived = lens.frames(spark, sf_dir).where("c in ('click', 'view')").withColumn("arrival", F.col("seq"))
    return ring.complete_planes(arrived, [], ["p", "t", "z"], 2)


@_query("select event_id, (user_id * 4 + event_id % 4) as position, event_id // 10 as t, cast(0 as bigint) as z, case when event_type = 'click' then 1 else 0 end as c from events")
def frame_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("p"), (F.col("event_id") % 4).cast("long").alias("g"), F.floor(F.col("event_id") / 10).cast("long").alias("t"), (F.col("event_type") == "click").alias("k"))
    own = F.map_concat(F.create_map(F.lit("p"), "p", F.lit("g"), "g", F.lit("t"), "t"), F.when(F.col("k"), F.create_map(F.lit("c"), F.lit(1).cast("long"))).otherwise(F.create_map().cast("map<string,bigint>")))
    return ring.messages(e.select("event_id", own.alias("index")), 4).withColumn("c", F.col("c").cast("int"))


@_query(f"""with {VOLUMES_SQL}, w as (select i as place, i * 3 as slot from range(20) x(i)), f as (select vec_id % 37 as slot, min(vec_id) as vec_id from volumes where p < 5 group by 1)
    select place, string_agg(coalesce(cast(floor(v.v * 1000) as int), 0), ',' order by x.x) as pixels
    from w cross join range(4) x(x) left join f using (slot) left join voxels v on v.vec_id = f.vec_id and v.z = 0 and v.y = 2 and v.x = x.x group by place""")
def ring_rows(spark, sf_dir):
    """One row of frames from wanted slots, zeros where the ring holds none."""
    first = lens.volumes(spark, sf_dir).where("p < 5").groupBy((F.col("vec_id") % 37).alias("slot")).agg(F.min_by("voxels", "vec_id").alias("v"))
    frames = first.select("slot", F.transform("v", lambda x: F.floor(x * 1000).cast("int")).alias("pixels"))
    wanted = spark.range(20).select(F.col("id").alias("place"), (F.col("id") * 3).alias("slot"))
    return ring.read_rows(wanted, frames, 2, SIDE).select("place", F.array_join(F.col("pixels").cast("array<string>"), ",").alias("pixels"))


# --- streams ---------------------------------------------------------------------------------------------


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def _run_stream(spark: SparkSession, rows: DataFrame, schema: str, provider: str | None = None) -> DataFrame:
    """Run a stream over all there is into the shared folder, and read what it wrote."""
    path, before = shared_path(spark, "stream"), spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, provider or before)
    try:
        query = rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)
    return spark.read.schema(schema).parquet(f"{path}/rows")


def _streamed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """A stream over rows that are first written to the shared folder."""
    path = shared_path(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


BATCH = 1 << 20  # rows of a micro-batch, about


def _streamed_in_order(spark: SparkSession, rows: DataFrame, order: str, name: str) -> DataFrame:
    """The same in micro-batches of about BATCH rows, by ranges of ``order``: a key that holds much comes in many parts.

    The file source takes files by their time, which a job's tasks leave open: files get theirs by number.
    """
    rows = stored(rows, f"{name}-rows")
    path = shared_path(spark, name)
    rows.repartitionByRange(-(-rows.count() // BATCH) or 1, order).write.option("maxRecordsPerFile", 0).parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for k, file in enumerate(found):
        files.setTimes(file, 1_000_000_000_000 + 1000 * k, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d").parquet(path)


@_query(STACKS_SQL + ">= 4")
def stream_stacks(spark, sf_dir):
    """The same stacks as ``stack_complete``, assembled by the stream."""
    found = _run_stream(spark, assemble.stacks(_streamed(spark, lens.frames(spark, sf_dir).select("p", "c", "seq", "v"), "frames"), N_Z, None), assemble.STACK)
    return found.select("p", "c", "stack", F.col("n").cast("long").alias("n"))


TRACKED = {
    "input_channel": "BF",
    "tracking_channel": "BF",
    "tracking_method": "multiotsu_center_of_mass",
    "reference_update_interval": INTERVAL,
    "tracking_interval": 2,
    "shift": {"limits": LIMITS, "dampening": [DAMPENING[a] for a in "zyx"]},
    "image_to_stage_matrix_xyz": MATRIX,
}
_TRACK_LIMIT = {a: LIMIT_SQL[a].replace(f"d_{a}", f"(a.d_{a} - b.d_{a})") for a in "zyx"}


@_query(f"""with {VOLUMES_SQL}, {ASOF_SQL}, {COM_SQL},
    s as (select o.p, o.t, o.reference, not o.anchor and o.t % 2 = 0 as tracked, """ + ", ".join(f"case when not o.anchor and o.t % 2 = 0 then ({_TRACK_LIMIT[a]}) * {DAMPENING[a]}e0 else 0 end as s_{a}" for a in "zyx") + f"""
          from o join d a on a.vec_id = o.vec_id join d b on b.vec_id = o.reference)
    select p, t, reference, tracked, """ + ", ".join(f"{r6(f's_{a}')} as shift_{a}" for a in "zyx") + f""",
        {r6("100 - sum(-s_y) over (partition by p order by t)")} as x, {r6("50 - sum(s_x) over (partition by p order by t)")} as y, {r6("10 - sum(s_z) over (partition by p order by t)")} as z from s""")
def stream_track(spark, sf_dir):
    """Positions followed by the stream: shifts of centres, limited, dampened, in stage axes, on tracked timepoints."""
    centres = _centre_shifts(spark, sf_dir).select("vec_id", "p", "t", *[f"c_{a}" for a in "zyx"])
    stream = assemble.tracked(_streamed(spark, centres, "centres"), checked("dynatrack", TRACKED), SCALE, {"x": 100.0, "y": 50.0, "z": 10.0})
    found = _run_stream(spark, stream, assemble.TRACK)
    return found.select("p", "t", "reference", "tracked", *[round6(F.col(c)).alias(c) for c in ("shift_z", "shift_y", "shift_x", "x", "y", "z")])


@_query(f"""with {RING_SQL} select m.c, m.arrival, m.p, m.t, g.completed is not null and m.arrival >= g.completed as complete, case when d.first is null then 0 else 1 end as evicted
    from m join g using (c, p, t, first) left join g d on d.c = m.c and d.first = m.arrival - 16""")
def stream_live(spark, sf_dir):
    """What the live view's stream makes of each arrival: whether its volume is whole, and whether it drops another."""
    stream = _streamed_in_order(spark, lens.frames(spark, sf_dir).select("c", "seq", "p", "t", "z"), "seq", "frames")
    found = _run_stream(spark, assemble.live_view(stream, SLOTS, N_Z), assemble.LIVE)
    return found.withColumn("evicted", F.col("evicted").cast("int"))


@_query(f"""with recursive {FRAMES_SQL}, a as (select p, seq, seq * 60.0e0 as s, v > 250 as ok from frames),
    l as (select p, min(s) as last from a group by p
          union all select l.p, n.s from l, lateral (select min(x.s) as s from a x where x.p = l.p and x.ok and x.s > l.last + 3600) n where n.s is not null)
    select a.p, a.seq, coalesce(a.s - (select max(l.last) from l where l.p = a.p and l.last < a.s), 0) > 3600 as due, coalesce(a.s - (select max(l.last) from l where l.p = a.p and l.last < a.s), 0) as waited from a""")
def stream_refocus_timer(spark, sf_dir):
    """When a refocus is due, where only successes (values above 250) start the time anew."""
    attempts = lens.frames(spark, sf_dir).select("p", "seq", (F.col("seq") * 60.0).alias("s"), (F.col("v") > 250).alias("ok"))
    return _run_stream(spark, assemble.refocus_timer(_streamed(spark, attempts, "attempts"), 3600.0), assemble.TIMER)


# --- replay selection ------------------------------------------------------------------------------------


@_query("""select row_number() over (order by cast(p as varchar)) - 1 as p, cast(p as varchar) as key from (select distinct user_id as p from events)""")
def position_keys(spark, sf_dir):
    return fr.position_keys(lens.frames(spark, sf_dir), "p")


KNOWN = [(0, "click"), (1, "view"), (2, "signup")]
KNOWN_SQL = "known(p, key) as (values (cast(0 as bigint), 'click'), (1, 'view'), (2, 'signup'))"


def _known(spark) -> DataFrame:
    return spark.createDataFrame(KNOWN, "p long, key string")


@_query(f"""with {KNOWN_SQL} select event_id, coalesce(last_value(k.key ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row), 'click') as position
    from events left join known k on k.key = event_type""")
def replay_position(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return fr.current_position(events, _known(spark), ["user_id"], "event_id", "event_type", "click").select("event_id", "position")


@_query(f"""with {KNOWN_SQL}, e as (select event_id, user_id, case when event_id % 3 = 0 then event_type end as pos_name, case when event_id % 4 <> 1 then event_id % 5 end as p from events),
    f as (select e.*, coalesce(n.key, i.key) as found from e left join known n on n.key = e.pos_name left join known i on i.p = e.p)
    select event_id, coalesce(last_value(found ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row), 'click') as position from f""")
def replay_event_position(spark, sf_dir):
    i = F.col("event_id")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(i % 3 == 0, F.col("event_type")).alias("pos_name"), F.when(i % 4 != 1, i % 5).alias("p"))
    return fr.event_positions(events, _known(spark), ["user_id"], "event_id", "click").select("event_id", "position")


@_query("""select event_id, cast(place as int) as place, case when place = 1 then 6 else event_id % 7 + place * 9 end as z from events, range(3) r(place)""")
def replay_sequenced(spark, sf_dir):
    part = lambda k: F.struct(F.when(F.lit(k != 1), F.col("event_id") % 7 + k * 9).alias("z"))
    events = table(spark, sf_dir, "events").select("event_id", F.array(*[part(k) for k in range(3)]).alias("parts"))
    return fr.sequenced_slices(events, "parts", 13)


@_query("select event_id, (row_number() over (partition by user_id order by event_id) - 1) % 3 as t from events")
def replay_free_running(spark, sf_dir):
    return fr.free_running_time(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "event_id", 3).select("event_id", "t")


@_query("""select cast(s_acctbal as double) as x, 0.5e0 as y, cast(null as double) as z, s_name as label, 'listed' as kind from supplier union all select 1.0e0, 2.0e0, 3.0e0, 'FOV0', 'empty'""")
def position_list(spark, sf_dir):
    """A list of positions, and where the stage stands for an empty one."""
    listed = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").cast("double").alias("x"), F.lit(0.5).alias("y"), F.lit(None).cast("double").alias("z"), F.col("s_name").alias("label"))
    both = [fr.positions_or_current(rows, 1.0, 2.0, 3.0).withColumn("kind", F.lit(kind)) for rows, kind in ((listed, "listed"), (listed.where("label is null"), "empty"))]
    return both[0].unionByName(both[1])


@_query(f"with {FRAMES_SQL} select p, t, string_agg(cast(v as varchar), ',' order by z) as slices from (select p, t, z, cast(sum(cast(v * 100 as bigint)) as bigint) as v from frames where c = 'click' and z between 1 and 2 group by p, t, z) group by p, t")
def stack_slices(spark, sf_dir):
    clicks = lens.frames(spark, sf_dir).where("c = 'click'").groupBy("p", "t", "z").agg(F.sum(F.round(F.col("v") * 100).cast("long")).alias("v"))
    return fr.stacked(clicks, ["p", "t"], 1, 3, "v").select("p", "t", F.array_join(F.col("slices").cast("array<string>"), ",").alias("slices"))


@_query("""select event_id, case when event_id % 3 = 0 then 1.0e0 when event_id % 3 = 1 then 2.5e0 else 1.0e0 end as scale from events""")
def zscale_json(spark, sf_dir):
    """The z scale of image metadata, where it says one."""
    with_scale = '{"multiscales":[{"datasets":[{"coordinateTransformations":[{"type":"identity"},{"type":"scale","scale":[1.0,1.0,2.5,0.5,0.5]}]}]}]}'
    text = F.when(F.col("event_id") % 3 == 1, with_scale).when(F.col("event_id") % 3 == 2, '{"multiscales":[{"datasets":[{}]}]}')
    return table(spark, sf_dir, "events").select("event_id", text.alias("metadata")).select("event_id", fr.z_scale().alias("scale"))


@_query(f"with {FRAMES_SQL}, l as (select p, t, c, v, row_number() over (partition by p, t order by c <> 'view', c, seq) as k from frames) select p, t, c, v from l where k = 1")
def tracked_channel(spark, sf_dir):
    """The wanted channel of each timepoint, or its first one."""
    rows = lens.frames(spark, sf_dir).select("p", "t", "c", "v", F.struct("c", "seq").alias("place"))
    return fr.tracked_channel(rows, ["p", "t"], "c", "place", "view").select("p", "t", "c", "v")


# --- plans, wells, properties ----------------------------------------------------------------------------


@_query("""
    select p_partkey, kind, t, t * cast(p_size as double) as start_s
    from (select p_partkey, p_size, case when p_partkey % 2 = 0 then 'loops' else 'duration' end as kind,
                 unnest(range(case when p_partkey % 2 = 0 then p_size else cast(floor(360.0e0 / p_size) as bigint) + 1 end)) as t from part)""")
def time_plan(spark, sf_dir):
    """Timepoints of a plan for each part: every second one has loops, the others last six minutes."""
    loops = F.col("p_partkey") % 2 == 0
    plans = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(loops, F.col("p_size")).alias("loops"), F.when(~loops, 360.0).alias("duration"), F.when(loops, "loops").otherwise("duration").alias("kind"))
    return expand.time_plans(plans, "p_size", "loops", "duration").select("p_partkey", "kind", "t", "start_s")


@_query(f"""with w as (select cast(floor(n_nationkey / 6) as bigint) as r, n_nationkey % 6 as c from nation where n_nationkey < 24)
    select chr(cast(65 + r as int)) || (c + 1) as well, g, {r6("c * 19000.0e0 + (g % 2 - 0.5e0) * 198")} as x, {r6("-r * 19000.0e0 - (g // 2 - 0.5e0) * 198")} as y from w, range(4) g(g)""")
def well_grid(spark, sf_dir):
    wells = table(spark, sf_dir, "nation").where("n_nationkey < 24").select(F.floor(F.col("n_nationkey") / 6).cast("long").alias("row"), (F.col("n_nationkey") % 6).cast("long").alias("column"))
    grid = expand.well_grid(wells, 2, 2, (19000.0, 19000.0), (180.0, 180.0), (-10.0, -10.0))
    return grid.select("well", "g", round6(F.col("x")).alias("x"), round6(F.col("y")).alias("y"))


@_query("""select well, channel, exposure, power from (select distinct c_mktsegment as well from customer), (values ('BF', 10.0e0, cast(null as double)), ('GFP', 20.0e0, 5.0e0)) d(channel, exposure, power)""")
def well_defaults(spark, sf_dir):
    return expand.well_defaults(table(spark, sf_dir, "customer"), "c_mktsegment", ["BF", "GFP"], [10.0, 20.0], [None, 5.0])


@_query("select s_suppkey, substr(s_name, 1, 1) as well_row, substr(s_name, 2) as well_column from supplier")
def well_place(spark, sf_dir):
    row, column = scalars.well_place(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", row.alias("well_row"), column.alias("well_column"))


@_query("""select p_partkey, d.low, d.high from part left join (values (0, 0e0, 255e0), (1, 0e0, 65535e0), (2, -32768e0, 32767e0), (3, 0e0, 1e0)) d(k, low, high) on d.k = p_partkey % 4""")
def contrast_dtype(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("uint8", "uint16", "int16", "float32")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    low, high = scalars.display_range(kind)
    return table(spark, sf_dir, "part").select("p_partkey", low.alias("low"), high.alias("high"))


@_query("select event_id, case when event_id % 2 = 0 then 'Laser' else 'Laser,Stage' end as free, case when event_id % 2 = 0 then 'Z,Laser' else 'Laser,Stage' end as unlocked from events")
def focus_moves(spark, sf_dir):
    """Properties that are set while autofocus holds the stage, and while it doesn't."""
    one = lambda d, q: F.struct(F.lit(d).alias("device"), F.lit(q).alias("property"), F.lit("1").alias("value"))
    held = F.when(F.col("event_id") % 2 == 0, F.array(one("Z", "Position"), one("Laser", "State"))).otherwise(F.array(one("Laser", "Position"), one("Stage", "Position")))
    names = lambda p: F.array_join(F.transform(p, lambda q: q["device"]), ",")
    return table(spark, sf_dir, "events").select("event_id", names(expand.without_focus_moves(held, "Z", True)).alias("free"), names(expand.without_focus_moves(held, "Z", False)).alias("unlocked"))


@_query("select event_id, event_type from events where event_type is null or event_type not in ('click', 'view')")
def quiet_log(spark, sf_dir):
    return expand.worth_logging(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ("click", "view"))


# --- position store --------------------------------------------------------------------------------------


@_query(f"""select s_suppkey as p, case when s_suppkey % 3 = 0 then 0e0 else s_acctbal end as x, 0e0 as y, case when s_suppkey % 2 = 0 then s_suppkey * 1.5e0 when s_suppkey % 5 = 0 then null else 7e0 end as z from supplier""")
def store_init(spark, sf_dir):
    k = F.col("s_suppkey")
    held = F.when(k % 2 == 0, F.array(F.struct(F.lit("ObjectiveZ").alias("device"), F.lit("Position").alias("property"), (k * 1.5).cast("string").alias("value"))))
    rows = table(spark, sf_dir, "supplier").select(k.alias("p"), F.when(k % 3 != 0, F.col("s_acctbal").cast("double")).alias("x"), F.lit(None).cast("double").alias("y"), F.when(k % 5 != 0, 7.0).alias("z"), held.alias("properties"))
    return expand.store_from_plan(rows, "ObjectiveZ")


#: Positions below 40, written once for each event of type 'view'; the last write counts.
STORE_SQL = "store as (select user_id as p, arg_max(value, event_id) as x, arg_max(value * 2, event_id) as y, arg_max(case when user_id % 4 <> 0 then value + 1 end, event_id) as z from events where event_type = 'view' and user_id < 40 group by user_id)"


def _store(spark, sf_dir) -> DataFrame:
    writes = table(spark, sf_dir, "events").where("event_type = 'view' and user_id < 40")
    rows = writes.select(F.col("user_id").alias("p"), "event_id", F.col("value").alias("x"), (F.col("value") * 2).alias("y"), F.when(F.col("user_id") % 4 != 0, F.col("value") + 1).alias("z"))
    return track.latest(rows, "event_id")


@_query(f"""with {STORE_SQL.replace("arg_max(case when user_id % 4 <> 0 then value + 1 end, event_id)", "case when user_id % 4 <> 0 then arg_max(value + 1, event_id) end")}
    select e.event_id, {r6("coalesce(s.x, e.event_id)")} as x_pos, {r6("coalesce(s.y, 1)")} as y_pos, {r6("coalesce(s.z, -1)")} as z_pos, s.z is not null as device_set from events e left join store s on s.p = e.user_id""")
def position_override(spark, sf_dir):
    """Events moved to the latest stored positions, once by z_pos and once by a device's property."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("p"), F.col("event_id").cast("double").alias("x_pos"), F.lit(1.0).alias("y_pos"), F.lit(-1.0).alias("z_pos"))
    empty = F.array().cast("array<struct<device:string,property:string,value:string>>")
    store = _store(spark, sf_dir)
    plain = track.override_positions(e, store)
    device = track.override_positions(e.withColumn("properties", empty), store, "ObjectiveZ").select("event_id", (F.size("properties") > 0).alias("device_set"), F.col("z_pos").alias("own"))
    return plain.join(device.where("own = -1"), "event_id").select("event_id", *[round6(F.col(c)).alias(c) for c in ("x_pos", "y_pos", "z_pos")], "device_set")


@_query(f"""with {FRAMES_SQL}, {STORE_SQL.replace("arg_max(case when user_id % 4 <> 0 then value + 1 end, event_id)", "case when user_id % 4 <> 0 then arg_max(value + 1, event_id) end")},
    st as (select p, t, seq, row_number() over (partition by p, t order by seq) as k from frames where z = 3),
    a as (select st.*, (p + t) % 3 <> 0 and k = 1 as has, s.p is not null as known, s.x as sx from st left join store s using (p)),
    d as (select *, case when has then 'update' when not known then 'drop' when t % 4 = 0 then 'refresh' else 'skip' end as action from a)
    select seq, action, {r6("case action when 'update' then 100 * p + t when 'refresh' then sx end")} as x from d""")
def baseline_pop(spark, sf_dir):
    """What happens with each complete stack: its baseline is there once, or was never written."""
    stacks = lens.frames(spark, sf_dir).where("z = 3").select("p", "t", "seq")
    base = stacks.select("p", "t").distinct().where("(p + t) % 3 <> 0").select("p", "t", (F.col("p") * 100.0 + F.col("t")).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return track.completed(stacks, base, _store(spark, sf_dir), "seq", 4).select("seq", "action", round6(F.col("x")).alias("x"))


@_query(f"with {VOLUMES_SQL}, {SHIFT_SQL}, l as (select *, row_number() over (partition by p order by t desc) as k from s) select p as position_index, t as timepoint_index, {r6('s_z')} as shift_z_um, {r6('s_x')} as shift_x_um from l where k = 1")
def last_shift(spark, sf_dir):
    """The latest logged shift of each position."""
    log = _tracked(spark, sf_dir).select(F.col("p").alias("position_index"), F.col("t").alias("timepoint_index"), F.col("s_z").alias("shift_z_um"), F.col("s_x").alias("shift_x_um"))
    found = fr.last_shift(log, ["position_index"], "timepoint_index")
    return found.select("position_index", "timepoint_index", *[round6(F.col(c)).alias(c) for c in ("shift_z_um", "shift_x_um")])


@_query(f"with {VOLUMES_SQL}, {SHIFT_SQL} select p as \"PositionID\", t as \"TimepointID\", " + ", ".join(f"{r6(f'case when t = 0 then 0 else s_{a} end')} as \"Shift{a.upper()}\"" for a in "zyx") + ", " + ", ".join(f"{r6(f'({BASE_SQL[a]}) - ({STAGE_SQL[a]})')} as \"Stage{a.upper()}\"" for a in "zyx") + " from s")
def archived_log(spark, sf_dir):
    rows = _tracked(spark, sf_dir).select(F.col("p").alias("position_index"), F.col("t").alias("timepoint_index"), *[F.col(f"s_{a}").alias(f"shift_{a}_um") for a in "zyx"], *[f"stage_{a}" for a in "xyz"])
    log = sinks.archived_log(rows)
    return log.select("PositionID", "TimepointID", *[round6(F.col(c)).alias(c) for c in sinks.ARCHIVED_LOG[2:]])


# --- exposure, focus, correlation ------------------------------------------------------------------------


@_query(f"""with {FRAMES_SQL}, q as (select c, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.9) as hi from frames group by c)
    select seq, case when v > lo then 0e0 else v end as under, case when v > hi then 255e0 else v end as over, v as nominal from frames join q using (c)""")
def exposure_synthetic(spark, sf_dir):
    return exposure.synthetic(lens.frames(spark, sf_dir), ["c"], "v", 0.0, 255.0).select("seq", "under", "over", "nominal")


#: A camera that sees power times a gain of its own: 1 too bright, -1 too dark, no flag for gains of zero.
FLAG_SQL = "case when gain = 0 then null when power * gain > 60 then 1 when power * gain < 40 then -1 else 0 end"


@_query(f"""with recursive s as (select s_suppkey as k, (s_suppkey % 23) * 1.0e0 as gain from supplier),
    l(k, gain, exposure, power, state, i) as (
        select k, gain, 50e0, 5e0, 'open', 0 from s
        union all
        select k, gain, case when flag is null or flag = 0 then exposure else next_e end, case when flag is null or flag = 0 then power else next_p end,
            case when flag is null then 'failed' when flag = 0 then 'found' when next_e in (1, 100) and next_p in (1, 10) then 'limit' else 'open' end, i + 1
        from (select *, {FLAG_SQL} as flag, round_even(case when power between 1 and 10 then power - 2 * ({FLAG_SQL}) else power end, 0) as next_p,
                     round_even(case when not power between 1 and 10 and exposure <= 100 then exposure - 10 * ({FLAG_SQL}) else exposure end, 0) as next_e from l where state = 'open' and i < 6))
    select k, arg_max(exposure, i) as exposure, arg_max(power, i) as power, arg_max(state, i) as state from l group by k""")
def exposure_loop(spark, sf_dir):
    """Exposure and power stepped until the image of each supplier's camera is right."""
    start = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(50.0).alias("exposure"), F.lit(5.0).alias("power"))

    def measure(rows: DataFrame) -> DataFrame:
        seen = F.col("power") * (F.col("k") % 23)
        flag = F.when(F.col("k") % 23 == 0, None).when(seen > 60, 1).when(seen < 40, -1).otherwise(0)
        return rows.select("k", flag.alias("flag"))

    limits = {"exposure_range": (1.0, 100.0), "power_range": (1.0, 10.0), "power_step": 2.0, "exposure_step": 10.0}
    return exposure.adjust(start, measure, ["k"], 6, **limits)


@_query(f"""with o as (select s_suppkey, s_suppkey % 35 * 1.0e0 as pos, -3.3e0 + i * 0.3e0 as o from supplier, range(23) r(i)), k as (select s_suppkey, count(*) as n, min(o) as lo, max(o) as hi from o where o + pos >= 0 and o + pos <= 30 group by s_suppkey)
    select s.s_suppkey, case when k.n >= 3 then k.n end as n, case when k.n >= 3 then {r6("lo")} end as low, case when k.n >= 3 then {r6("hi")} end as high from supplier s left join k using (s_suppkey)""")
def focus_range(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 35).cast("double").alias("at"), F.lit(-3.3).alias("start"), F.lit(3.3).alias("end"))
    found = control.valid_range(rows, "at", "start", "end", 0.3)
    return found.select("s_suppkey", F.when(F.col("offsets").isNotNull(), F.size("offsets").cast("long")).alias("n"), round6(F.array_min("offsets")).alias("low"), round6(F.array_max("offsets")).alias("high"))


@_query(f"""with {VOLUMES_SQL}, {ASOF_SQL},
    f as (select vec_id, i, cast(embedding[i + 1] as double) as v from volumes, range(64) r(i)),
    k as (select o.vec_id, (m.i - r.i + 64) % 64 as lag, m.v * r.v as vv from o join f m on m.vec_id = o.vec_id join f r on r.vec_id = o.reference),
    s as (select vec_id, lag, abs(sum(vv)) as corr from k group by 1, 2)
    select vec_id, {r6("max(corr)")} as greatest, {r6("min(corr)")} as least, {r6("sum(corr)")} as total from s group by vec_id""")
def surface_stats(spark, sf_dir):
    """Greatest and least value and the sum of each correlation with the reference."""
    rows = _referenced(spark, sf_dir)
    pairs = rows.join(rows.select(F.col("vec_id").alias("reference"), F.col("voxels").alias("ref_voxels")), "reference")
    found = pairs.select("vec_id", register.surface(F.col("ref_voxels"), F.col("voxels"), (64,)).alias("s"))
    return found.select("vec_id", *[round6(F.col(f"s.{c}")).alias(c) for c in ("greatest", "least", "total")])


@_query(f"""with {VOLUMES_SQL}, {ASOF_SQL},
    f as (select vec_id, y, x, cast(embedding[(case when y = 7 then 5 else y end) * 9 + x + 1] as double) as v from volumes, range(8) a(y), range(9) b(x)),
    k as (select o.vec_id, (m.y - r.y + 8) % 8 as dy, (m.x - r.x + 9) % 9 as dx, m.v * r.v as vv from o join f m on m.vec_id = o.vec_id join f r on r.vec_id = o.reference),
    s as (select vec_id, dy, dx, round(abs(sum(vv)), 9) as corr from k group by 1, 2, 3),
    b as (select *, row_number() over (partition by vec_id order by corr desc, (12 - dy) % 8, (13 - dx) % 9) as k from s)
    select vec_id, cast(case when dy <= 4 then dy else dy - 8 end as double) as dy, cast(case when dx <= 4 then dx else dx - 9 end as double) as dx from b where k = 1""")
def xcorr_padded(spark, sf_dir):
    """Images of 7 by 9 pixels, reflected to 8 by 9 before they are correlated."""
    rows = _referenced(spark, sf_dir).withColumn("voxels", F.slice("voxels", 1, 63))
    pairs = rows.join(rows.select(F.col("vec_id").alias("reference"), F.col("voxels").alias("ref_voxels")), "reference")
    found = pairs.select("vec_id", register.pixel_shift("pcc", F.col("ref_voxels"), F.col("voxels"), (7, 9)).alias("shift"))
    return found.select("vec_id", F.col("shift")[0].alias("dy"), F.col("shift")[1].alias("dx"))


@_query("""
    with i as (select c_mktsegment as well_id, min(c_acctbal) as e from customer where c_mktsegment <> 'BUILDING' group by 1), w as (select distinct c_mktsegment as well_id from customer where c_mktsegment <> 'MACHINERY')
    select (select bool_and(e > -2000) from i) as exposures_ok, cast((select count(*) from i where well_id not in (select well_id from w)) as bigint) as only_left, cast((select count(*) from w where well_id not in (select well_id from i)) as bigint) as only_right""")
def illumination_complete(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "well_id")
    rows = customers.where("well_id <> 'BUILDING'").groupBy("well_id").agg(F.min("c_acctbal").alias("exposure_time_ms"))
    return control.illumination_complete(rows, customers.where("well_id <> 'MACHINERY'"), -2000.0)


@_query(f"""with {VOLUMES_SQL}, {ASOF_SQL} select vec_id, (vec_id % 5 = 0 and not anchor) as kept from o""")
def shift_kept(spark, sf_dir):
    """Volumes whose shift cannot be computed, as they are cut short, keep their position; references have no error of their own."""
    rows = _referenced(spark, sf_dir)
    references = rows.select(F.col("vec_id").alias("reference"), F.col("voxels").alias("ref_voxels"))
    broken = F.when((F.col("vec_id") % 5 == 0) & ~F.col("anchor"), F.slice("voxels", 1, 60)).otherwise(F.col("voxels"))
    shift = register.pixel_shift("pcc", F.col("ref_voxels"), broken, (SIDE,) * 3, guarded=True)
    moved = rows.join(references, "reference").select("vec_id", shift.alias("s"))
    place = track.corrected({a: F.lit(100.0) for a in "xyz"}, {a: F.col("s")[k] + 1000 for k, a in enumerate("zyx")})
    return moved.select("vec_id", (place["x"] == 100).alias("kept"))


# --- tiles -----------------------------------------------------------------------------------------------

TILE = (3, 4, 4)  # of volumes of 4 x 4 x 4: two, of different sizes
TILED_SHAPE = (SIDE,) * 3


def _tiles(spark, sf_dir) -> DataFrame:
    return tiles.from_voxels(lens.voxels(spark, sf_dir), "vec_id", TILED_SHAPE, TILE)


def _tile_pairs(spark, sf_dir) -> DataFrame:
    return _referenced(spark, sf_dir).select(F.col("vec_id").alias("pair"), "reference", F.col("vec_id").alias("moving"))


@_query(ORACLE_SQL["xcorr_shift_3d"])
def xcorr_tiled(spark, sf_dir):
    """Shifts of volumes in tiles, by spectra of planes and of columns."""
    return tiles.shifts(_tiles(spark, sf_dir), _tile_pairs(spark, sf_dir), "vec_id", TILED_SHAPE).withColumnRenamed("pair", "vec_id")


@_query(ORACLE_SQL["xcorr_padded"])
def xcorr_padded_tiled(spark, sf_dir):
    """Planes of 7 by 9 pixels in tiles of 4 by 5, reflected to 8 by 9 before they are correlated."""
    cells = lens.volumes(spark, sf_dir).select("vec_id", F.posexplode(F.slice("voxels", 1, 63)).alias("i", "v"))
    long = cells.select("vec_id", F.lit(0).alias("z"), F.floor(F.col("i") / F.lit(9)).alias("y"), F.pmod("i", F.lit(9)).alias("x"), "v")
    cut = tiles.from_voxels(long, "vec_id", (1, 7, 9), (1, 4, 5))
    return tiles.shifts(cut, _tile_pairs(spark, sf_dir), "vec_id", (1, 7, 9)).select(F.col("pair").alias("vec_id"), "dy", "dx")


@_query(ORACLE_SQL["gaussian_blur"])
def blur_tiled(spark, sf_dir):
    """A blur of tiles that exchange their borders; its radius reaches over a whole tile."""
    soft = tiles.to_voxels(tiles.blurred(_tiles(spark, sf_dir), "vec_id", TILED_SHAPE, TILE, 0.5), "vec_id")
    return soft.select("vec_id", (F.col("z") * 16 + F.col("y") * 4 + F.col("x")).alias("i"), round6(F.col("v")).alias("v"))


@_query(f"with {MASK_SQL} select vec_id, z, y, x, v from mask")
def mask_tiled(spark, sf_dir):
    """Masks of tiles, by the Otsu thresholds of their volume's histogram."""
    mask = tiles.to_voxels(tiles.masks(_tiles(spark, sf_dir), "vec_id", TILED_SHAPE, TILE, 5.0, 0), "vec_id")
    return mask.select("vec_id", "z", "y", "x", F.col("v").cast("int").alias("v"))


@_query(f"""with {VOLUMES_SQL} select vec_id, 'signal' as channel, z, y, x, {r6("2 * v + 1")} as v from voxels
    union all select vec_id, 'inverse', z, y, x, {r6("-v")} from voxels""")
def windows_blended(spark, sf_dir):
    """Two channels made in overlapping windows of 3 voxels and blended: what is made voxel by voxel comes back unchanged."""
    model = lambda window: {"signal": 2 * window + 1, "inverse": -window}
    made = tiles.windowed(_tiles(spark, sf_dir), "vec_id", TILED_SHAPE, TILE, (4, 4, 3), (0, 0, 1), model)
    long = made.withColumn("id", F.struct("vec_id", "channel"))
    return tiles.to_voxels(long, "id").select("id.vec_id", "id.channel", "z", "y", "x", round6(F.col("v")).alias("v"))


@_query(f"with {VOLUMES_SQL} select vec_id, (z + 3) % 4 as z, (y + 3) % 4 as y, x, {r6('v * 2 / 4.5e0')} as v from voxels")
def inverse_filter(spark, sf_dir):
    """What a filter that moves by one plane and one line, and doubles, was applied to."""
    moved = tiles.inverse_filtered(_tiles(spark, sf_dir), "vec_id", TILED_SHAPE, lambda z, y, x: 2 * np.exp(-2j * np.pi * (z + y + 0 * x)), 0.5)
    return tiles.to_voxels(moved, "vec_id").select("vec_id", "z", "y", "x", round6(F.col("v")).alias("v"))


SKEW = {"angle_degrees": 30.0, "ratio": 0.5, "average": 2}


@_query(f"""with {VOLUMES_SQL}, h as (select h, h / 0.5e0 as tilt from range(2) r(h)), a as (select a from range(12) r(a)),
    w as (select h, a, s, k, greatest(0, 1 - abs(tilt - k)) * greatest(0, 1 - abs((a - tilt * cos(pi() / 6)) / 2 - s)) as w from h, a, range(4) i(s), range(4) j(k))
    select vec_id, 0 as z, a as y, x, {r6("sum(w * v) / 2")} as v from w join voxels on z = s and y = k group by vec_id, a, x""")
def deskew_tiled(spark, sf_dir):
    """Light-sheet stacks in tiles, seen upright: two heights averaged, the overhang kept."""
    made = tiles.deskewed(_tiles(spark, sf_dir), "vec_id", TILED_SHAPE, (1, 5, 3), **SKEW)
    return tiles.to_voxels(made, "vec_id").select("vec_id", "z", "y", "x", round6(F.col("v")).alias("v"))


def _by_settings(method: str, like: str, places: int | None = None, **sections):
    """A query that shifts tiles by checked settings which name the method; its rows are those of the query ``like``."""

    def query(spark, sf_dir):
        tracking = checked("dynatrack", {"input_channel": "BF", "tracking_channel": "BF", "tracking_method": method, **sections})
        found = tiles.settings_shifts(_tiles(spark, sf_dir), _tile_pairs(spark, sf_dir), "vec_id", TILED_SHAPE, TILE, tracking)
        return found.select(F.col("pair").alias("vec_id"), *[(round6(F.col(f"d{a}")) if places else F.col(f"d{a}")).alias(f"d{a}") for a in "zyx"])

    query.__name__, query.__doc__ = f"settings_{method}", f"Shifts by settings of the method {method}."
    _query(ORACLE_SQL[like])(query)


_by_settings("pcc", "xcorr_shift_3d")
_by_settings("multiotsu_pcc", "otsu_pcc_shift")
_by_settings("multiotsu_center_of_mass", "otsu_com_shift", 6)
_by_settings("roi_center_pcc", "roi_pcc_shift")


# --- stores ----------------------------------------------------------------------------------------------


def _stored_volumes(spark, sf_dir) -> DataFrame:
    """Every volume, written to a plate of sharded arrays (a well for each position) and read from there."""
    volumes, path = lens.volumes(spark, sf_dir), shared_path(spark, "store")
    planes = volumes.select("p", "t", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("z"), "voxels")
    cells = SIDE * SIDE
    key = F.concat(F.lit("A/"), F.col("p").cast("string"), F.lit("/0"))
    whole = {"c": F.lit(0), "y0": F.lit(0), "x0": F.lit(0), "ny": F.lit(SIDE), "nx": F.lit(SIDE)}
    frames = planes.select(key.alias("position"), "t", "z", *[v.alias(n) for n, v in whole.items()], F.slice("voxels", F.col("z") * cells + 1, F.lit(cells)).alias("pixels"))
    shape = (volumes.agg(F.max("t")).first()[0] + 1, 1, SIDE, SIDE, SIDE)
    store.write(frames, path, shape, "float64", (4, 1, SIDE, SIDE, SIDE), (64, 1, SIDE, SIDE, SIDE))
    found = store.read(spark, path)
    return found.withColumn("p", F.split("position", "/")[1].cast("long"))


def _pixels(frames: DataFrame) -> DataFrame:
    long = frames.select("p", "t", "z", "y0", "x0", "nx", F.posexplode("pixels").alias("i", "v"))
    return long.select("p", "t", "z", (F.col("y0") + F.floor(F.col("i") / F.col("nx"))).alias("y"), (F.col("x0") + F.pmod("i", "nx")).alias("x"), "v")


#: Timepoints that a position lacks lie in chunks of others of that position: they read as zero.
STORE_SQL = f"""with {VOLUMES_SQL}, n as (select p, max(t) as last from volumes group by p), m as (select max(last) as last from n),
    times as (select p, unnest(range(least(n.last // 4 * 4 + 4, m.last + 1))) as t from n, m),
    grid as (select p, t, z, y, x from times, range(4) i(z), range(4) j(y), range(4) k(x)),
    stored as (select p, t, z, y, x, coalesce(v, 0) + 0.0 as v from grid left join voxels using (p, t, z, y, x))"""


@_query(f"{STORE_SQL} select p, t, z, y, x, v from stored")
def store_round_trip(spark, sf_dir):
    """All volumes through a sharded image store."""
    return _pixels(_stored_volumes(spark, sf_dir)).withColumn("v", F.col("v") + 0.0)


@_query(f"{STORE_SQL} select p, t, z, y, x, v from stored where p = 3 and t between 5 and 20 and z < 2")
def store_part(spark, sf_dir):
    """What a request names of a store: other files and chunks are not opened."""
    asked = _stored_volumes(spark, sf_dir).where("position = 'A/3/0' and t >= 5 and t <= 20 and z < 2")
    return _pixels(asked).withColumn("v", F.col("v") + 0.0)


# --- positions by one stream -----------------------------------------------------------------------------

FOLLOWED = {
    "input_channel": "BF",
    "tracking_channel": "BF",
    "tracking_method": "pcc",
    "reference_update_interval": INTERVAL,
    "tracking_interval": 2,
    "shift": {"limits": {"z": (0.1, 3.0), "y": (0.6, 0.9), "x": (0.1, 5.0)}, "dampening": [0.5, 0.25, 0.1]},
    "image_to_stage_matrix_xyz": MATRIX,
}
_PEAKS_SQL = ORACLE_SQL["xcorr_shift_3d"]
_FOLLOW_UM = {
    a: f"case when abs(d{a} * {SCALE[a]}e0) < {low}e0 then 0 when abs(d{a} * {SCALE[a]}e0) > {high}e0 then sign(d{a}) * {high}e0 else d{a} * {SCALE[a]}e0 end * {damp}e0"
    for (a, (low, high)), damp in zip(FOLLOWED["shift"]["limits"].items(), FOLLOWED["shift"]["dampening"], strict=True)
}


@_query(_PEAKS_SQL[: _PEAKS_SQL.rindex("select vec_id, cast(case")].rstrip() + f""",
    d as ({_PEAKS_SQL[_PEAKS_SQL.rindex("select vec_id, cast(case"):]}),
    u as (select o.p, o.t, o.vec_id * 4 + 3 as seq, o.reference * 4 + 3 as reference, case when anchor then 'anchor' when o.t % 2 = 0 then 'update' else 'rest' end as action,
                 """ + ", ".join(f"case when not anchor and o.t % 2 = 0 then {_FOLLOW_UM[a]} else 0 end as s_{a}" for a in "zyx") + """ from o join d using (vec_id)),
    w as (select *, case when action <> 'rest' then t end as moved from u),
    l as (select *, last_value(moved ignore nulls) over (partition by p order by t rows between unbounded preceding and current row) as since from w)
    select l.p, l.t, l.seq, l.action, l.reference, """ + ", ".join(f"{r6(f'l.s_{a}')} as shift_{a}" for a in "zyx") + f""",
        {r6("l.p * 100 + l.since + m.s_y")} as x, {r6("l.p * 50.0 - m.s_x")} as y, {r6("10 - m.s_z")} as z
    from l join u m on m.p = l.p and m.t = l.since""")
def stream_positions(spark, sf_dir):
    """Planes that come one by one, counted into stacks and registered, to positions: one state machine each."""
    planes = lens.voxels(spark, sf_dir).groupBy("vec_id", "p", "t", "z").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("cells"))
    stage = {"x": F.col("p") * 100.0 + F.col("t"), "y": F.col("p") * 50.0, "z_stage": F.lit(10.0)}
    frames = planes.select("p", "t", "z", (F.col("vec_id") * 4 + F.col("z")).alias("seq"), F.col("cells.v").alias("data"), *[c.alias(n) for n, c in stage.items()])
    stream = positions.follow(_streamed(spark, frames, "planes"), checked("dynatrack", FOLLOWED), SCALE, TILED_SHAPE)
    found = _run_stream(spark, stream, positions.UPDATES, positions.PROVIDER)
    return found.select("p", "t", "seq", "action", "reference", *[round6(F.col(c)).alias(c) for c in ("shift_z", "shift_y", "shift_x", "x", "y", "z")])


@_query(f"""with {VOLUMES_SQL}, u as (select p, t, vec_id as version, 100.0e0 * p + t as x from volumes where t % 3 = 0),
    e as (select p, t, x from (select o_custkey % 10 as p, o_orderkey % 40 as t, o_orderkey as x from orders))
    select e.p, e.t, e.x as event, (select arg_max(u.x, u.t) from u where u.p = e.p and u.t < e.t) as x_pos from e""")
def position_barrier(spark, sf_dir):
    """Events with the position that earlier timepoints led to; what their own timepoint led to isn't visible yet."""
    updates = lens.volumes(spark, sf_dir).where("t % 3 = 0").select("p", "t", (F.col("p") * 100.0 + F.col("t")).alias("x"))
    events = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("p"), (F.col("o_orderkey") % 40).alias("t"), F.col("o_orderkey").alias("event"))
    return track.positions_before(events, updates, "p", "t", "x").select("p", "t", "event", F.col("x").alias("x_pos"))

"""Curve, report and diagnosis queries on the aggregated study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ragscale.operators import aggregate, bootstrap, curves, replicates
from ragscale.plans.catalog import NUDGE, query, r6, rounded
from ragscale.plans.evalview import AXIS, ev, eval_records, long_rows, poisson_cte
from ragscale.plans.statistics import KEYS, STATS, results, results_cte
from ragscale.schemas import CONFIG_KEY, PRACTICAL_DELTA

CURVE = ["model", "dataset", "subset", "pass"]
CURVE_SQL = ", ".join(CURVE)
REPORTED = ["cu", "sk", "hallucination", "faithfulness"]
ROUND = ", ".join(r6(c, c) for c in STATS)


def cu_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and interval of cu per configuration."""
    return bootstrap.poisson_ci(eval_records(spark, sf_dir), CONFIG_KEY, ["cu"], "event_id")


def _cte(body: str) -> str:
    return ev(f", {body}").replace(") ,", "),", 1)


_X = "case quantization " + " ".join(f"when '{q}' then {i}" for i, q in enumerate(AXIS)) + " end"
CU = f"""{poisson_cte("ev", CONFIG_KEY, ["cu"], "event_id")},
cu as (select *, {_X} as x from ({long_rows("boot", CONFIG_KEY, ["cu"])}))"""


@query("ordinal_sort", _cte(f"{CU} select {KEYS}, {_X} as x, {ROUND} from cu where x is not null"))
def _(spark, sf_dir):
    points = curves.on_axis(cu_points(spark, sf_dir), AXIS).orderBy(*CURVE, "x")
    return rounded(points.select(*CONFIG_KEY, "x", *STATS))


NO_Q6 = [q for q in AXIS if q != "Q6"]


@query("filter_series", ev(f"""select event_id, {KEYS}, {r6("cu", "cu")} from ev where pass like 'pass3%'
  and quantization in ({", ".join(f"'{q}'" for q in NO_Q6)}) and coalesce(source, 'local') = 'local'"""))
def _(spark, sf_dir):
    kept = curves.local_series(eval_records(spark, sf_dir), "pass3", NO_Q6)
    return rounded(kept.select("event_id", *CONFIG_KEY, "cu"))


def _slice_sql(where: str, metrics: list[str]) -> str:
    rows = " union all ".join(
        f"select {KEYS}, arg_min(coalesce(source, 'local'), event_id) as source, '{m}' as metric, "
        f"avg(coalesce({m}, 0.0)) as mean from ev group by {KEYS}" for m in metrics)
    return ev(f"select {KEYS}, metric, {r6('mean', 'mean')} from ({rows}) where {where} and pass like 'pass3%' and source = 'local'")


def _slice(spark: SparkSession, sf_dir: str, where, metrics: list[str]) -> DataFrame:
    means = aggregate.config_aggregate(eval_records(spark, sf_dir), "event_id", metrics=metrics)
    kept = curves.local_series(means, "pass3", AXIS).where(where)
    named = kept.select(*CONFIG_KEY, *[F.col(f"{m}_mean").alias(m) for m in metrics])
    return rounded(named.unpivot(CONFIG_KEY, metrics, "metric", "mean"))


@query("negative_rejection_slice", _slice_sql("subset = 'rejection'", ["cu"]))
def _(spark, sf_dir):
    return _slice(spark, sf_dir, F.col("subset") == "rejection", ["cu"])


@query("floor_model_slice", _slice_sql("model = 'error'", ["cu", "sk"]))
def _(spark, sf_dir):
    return _slice(spark, sf_dir, F.col("model") == "error", ["cu", "sk"])


@query("plot_series", _cte(f"""{CU},
deg as (select {KEYS}, pass like 'pass3%' and avg(cu) < 0.3 as degraded from ev group by {KEYS})
select {", ".join("c." + k for k in CURVE)}, row_number() over (partition by {", ".join("c." + k for k in CURVE)} order by x) - 1 as point,
  x, {r6("mean", "y")}, {r6("mean - ci_lo", "err_lo")}, {r6("ci_hi - mean", "err_hi")}, degraded
from cu c join deg d on {" and ".join(f"c.{k} = d.{k}" for k in CONFIG_KEY)}"""))
def _(spark, sf_dir):
    flag = aggregate.degraded_flag(F.col("pass"), F.col("mean"))
    series = curves.plot_series(cu_points(spark, sf_dir).withColumn("capability_degraded", flag), CURVE, AXIS)
    points = series.select(*CURVE, F.posexplode("points").alias("point", "p")).select(
        *CURVE, F.col("point").cast("bigint").alias("point"), "p.*")
    return rounded(points)


@query("baseline_delta", _cte(f"""{CU}, d as (select *, max(case when quantization = 'FP16' then mean end) over w as b,
  max(case when quantization = 'FP16' then ci_lo end) over w as bl, max(case when quantization = 'FP16' then ci_hi end) over w as bh
  from cu window w as (partition by {CURVE_SQL}))
select {KEYS}, {r6("mean", "mean")}, {r6("b", "base_mean")}, {r6("mean - b", "delta")},
  coalesce(abs(mean - b) > 0.05 and (ci_lo > bh or bl > ci_hi), false) as practical from d"""))
def _(spark, sf_dir):
    out = curves.baseline_delta(cu_points(spark, sf_dir), CURVE)
    return rounded(out.select(*CONFIG_KEY, "mean", "base_mean", "delta", "practical"))


PATTERN = f"""steps as (select *, mean - lag(mean) over (partition by {CURVE_SQL} order by x desc) as step from cu where x is not null),
shape as (select {CURVE_SQL}, count(*) as n_points, bool_and(step > 0) as up, bool_and(step < 0) as down,
  arg_max(x, mean) as peak, arg_max(ci_lo, mean) as peak_lo, max(case when x = 0 then ci_hi end) as end_hi, max(case when x = 0 then ci_lo end) as end_lo,
  max(ci_lo) as max_lo, min(ci_hi) as min_hi, max(case when x = 5 then ci_lo end) as base_lo,
  max(case when x = 5 then ci_hi end) as base_hi from steps group by {CURVE_SQL}),
patterns as (select {CURVE_SQL}, n_points, case when n_points < 2 then 'indeterminate'
  when max_lo <= base_hi and min_hi >= base_lo then 'resilient' when up and end_lo > base_hi then 'gullible'
  when down and end_hi < base_lo then 'stubborn' when peak > 0 and peak < 5 and end_hi < peak_lo then 'inverted_u' else 'indeterminate' end as pattern from shape)"""


@query("curve_pattern", _cte(f"{CU}, {PATTERN} select {CURVE_SQL}, n_points, pattern from patterns"))
def _(spark, sf_dir):
    return curves.curve_pattern(cu_points(spark, sf_dir), CURVE, AXIS)


def role_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role per model, read off the records; one model has none."""
    models = eval_records(spark, sf_dir).select("model").distinct()
    role = F.expr("case model when 'click' then 'primary' when 'view' then 'primary' when 'purchase' then 'secondary' "
                  "when 'error' then 'floor' end")
    return models.select("model", role.alias("role")).where("role is not null")


ROLES = """roles as (select distinct model, case model when 'click' then 'primary' when 'view' then 'primary'
  when 'purchase' then 'secondary' when 'error' then 'floor' end as role from ev where model <> 'signup')"""


@query("falsification", _cte(f"""{CU}, {PATTERN}, {ROLES}
select count(distinct p.model) as n_models, count(distinct case when pattern = 'gullible' then p.model end) as n_gullible_models,
  not coalesce(bool_or(pattern = 'gullible'), false) as refuted
from patterns p join roles r on p.model = r.model where r.role = 'primary'"""))
def _(spark, sf_dir):
    patterns = curves.curve_pattern(cu_points(spark, sf_dir), CURVE, AXIS)
    return curves.falsification(patterns, role_table(spark, sf_dir))


CROSS = [("click", "view"), ("purchase", "signup"), ("click", "purchase")]


@query("cross_arch_pairs", _cte(f"""{CU}, pairs(a, b) as (values {", ".join(str(p) for p in CROSS)})
select l.model as model_a, r.model as model_b, {", ".join("l." + k for k in CONFIG_KEY[1:])}, {r6("l.mean", "a_mean")},
  {r6("r.mean", "b_mean")}, {r6("l.mean - r.mean", "delta")}, l.ci_lo <= r.ci_hi and r.ci_lo <= l.ci_hi as ci_overlap
from pairs p join cu l on l.model = p.a join cu r on r.model = p.b and {" and ".join(f"l.{k} = r.{k}" for k in CONFIG_KEY[1:])}"""))
def _(spark, sf_dir):
    return rounded(curves.cross_pairs(cu_points(spark, sf_dir), CROSS, CONFIG_KEY[1:]))


_FLAG = "(not isnan(ci_hi - ci_lo) and ci_hi - ci_lo > mean * 0.15)"


@query("ci_width_flag", _cte(f"""{results_cte(tuple(REPORTED))}
select {KEYS}, metric, {r6("ci_hi - ci_lo", "width")}, {_FLAG} as flagged from res"""))
def _(spark, sf_dir):
    rows = curves.flag_width(_reported(spark, sf_dir))
    return rounded(rows.select(*CONFIG_KEY, "metric", (F.col("ci_hi") - F.col("ci_lo")).alias("width"), "flagged"))


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.aggregate_results(eval_records(spark, sf_dir), "event_id", "event_id", metrics=REPORTED)


def _wide_cols() -> str:
    out = []
    for m in REPORTED:
        pick = lambda c: f"max(case when metric = '{m}' then {c} end)"
        out += [r6(pick("mean"), f"{m}_mean"), r6(pick("ci_lo"), f"{m}_ci_low"), r6(pick("ci_hi"), f"{m}_ci_high"),
                f"{pick(f'case when {_FLAG} then {chr(39)}YES{chr(39)} end')} as {m}_flagged"]
    return ", ".join(out)


@query("summary_wide", _cte(f"{results_cte(tuple(REPORTED))} select {KEYS}, n_queries, {_wide_cols()} from res group by {KEYS}, n_queries"))
def _(spark, sf_dir):
    return rounded(curves.summary_wide(_reported(spark, sf_dir), [*CONFIG_KEY, "n_queries"], REPORTED))


def _cell(m: str) -> str:
    num = lambda c: f"printf('%.3f', round(round({c} + {NUDGE}::double, 9), 3))"
    cell = f"{num('mean')} || ' [' || {num('ci_lo')} || ', ' || {num('ci_hi')} || ']' || case when {_FLAG} then ' **!**' else '' end"
    return f"coalesce(max(case when metric = '{m}' then {cell} end), 'N/A') as {m}"


@query("summary_report", _cte(f"{results_cte(tuple(REPORTED))} select {KEYS}, n_queries, {', '.join(_cell(m) for m in REPORTED)} from res group by {KEYS}, n_queries"))
def _(spark, sf_dir):
    off_ties = {c: F.col(c) + F.lit(NUDGE) for c in ("mean", "ci_lo", "ci_hi")}
    cells = curves.report_cells(_reported(spark, sf_dir).withColumns(off_ties))
    wide = cells.groupBy(*CONFIG_KEY, "n_queries").pivot("metric", REPORTED).agg(F.first("cell"))
    return wide.select(*CONFIG_KEY, "n_queries", *[F.coalesce(m, F.lit("N/A")).alias(m) for m in REPORTED])


TRIPLE = ["model", "quantization", "dataset", "subset", "query_id"]


@query("three_pass_triple", ev(f""", last as (select {", ".join(TRIPLE)}, pass, arg_max(cu, event_id) as cu,
  arg_max(overall_recall, event_id) as rec from ev group by {", ".join(TRIPLE)}, pass),
t as (select {", ".join(TRIPLE)}, max(case when pass = 'pass1' then rec end) >= 0.5 as knows,
  max(case when pass = 'pass2' then cu end) >= 0.5 as follows_loose,
  max(case when pass = 'pass3' then cu end) >= 0.5 as follows_strict from last group by {", ".join(TRIPLE)})
select *, case when knows is null or follows_loose is null or follows_strict is null then 'incomplete'
  when knows and follows_loose and follows_strict then 'confidence_erosion'
  when knows and not follows_loose and follows_strict then 'preference'
  when not knows and follows_loose and follows_strict then 'uninformative' else 'other' end as diagnosis from t""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    return curves.three_pass_triple(eval_records(spark, sf_dir), "event_id", TRIPLE)


__all__ = ["cu_points", "results", "role_table"]


# --- replicate vectors: differences of configurations over the same queries, and shapes of curves ---

_PQ = f"""pq as (select {KEYS}, query_id, avg(coalesce(cu, 0.0)) as cu from ev group by {KEYS}, query_id),
{poisson_cte("pq", CONFIG_KEY, ["cu"], "query_id", "pb")}"""
_DELTA = ", ".join(r6(c, c) for c in ("mean", "other_mean", "delta", "ci_lo", "ci_hi"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate means of cu per configuration, the same query having the same weight in all of them."""
    means = replicates.per_query(eval_records(spark, sf_dir), CONFIG_KEY, ["cu"])
    return replicates.replicate_vectors(means, CONFIG_KEY, ["cu"], "query_id")


def _difference_sql(condition: str, extra: str) -> str:
    other = " and ".join(f"a.{k} = o.{k}" for k in CONFIG_KEY if k not in ("quantization", "model"))
    keys = ", ".join(f"a.{k}" for k in CONFIG_KEY)
    return f"""select {KEYS}, {extra} {_DELTA}, ci_lo > 0 or ci_hi < 0 as differs from (
  select {keys}, {"any_value(o.model) as other," if extra else ""} any_value(sa.cu_mean) as mean, any_value(so.cu_mean) as other_mean, any_value(sa.cu_mean) - any_value(so.cu_mean) as delta,
    quantile_cont(a.cu - o.cu, 0.025) as ci_lo, quantile_cont(a.cu - o.cu, 0.975) as ci_hi
  from pb_reps a join pb_reps o on a.b = o.b and {other} and {condition}
  join pb sa on {" and ".join(f"sa.{k} = a.{k}" for k in CONFIG_KEY)} join pb so on {" and ".join(f"so.{k} = o.{k}" for k in CONFIG_KEY)}
  group by {keys}{", o.model" if extra else ""})"""


@query("baseline_delta_paired", _cte(f"{_PQ} {_difference_sql(f"a.model = o.model and o.quantization = '{AXIS[-1]}' and a.quantization <> o.quantization", '')}"))
def _(spark, sf_dir):
    found = replicates.baseline_differences(query_vectors(spark, sf_dir), CONFIG_KEY, AXIS[-1])
    return rounded(found.select(*CONFIG_KEY, "mean", "other_mean", "delta", "ci_lo", "ci_hi", "differs"))


_MODELS = [("click", "view"), ("purchase", "signup"), ("click", "error")]


@query("cross_arch_paired", _cte(f"{_PQ} {_difference_sql('a.quantization = o.quantization and (' + ' or '.join(f"(a.model = '{a}' and o.model = '{b}')" for a, b in _MODELS) + ')', 'other,')}"))
def _(spark, sf_dir):
    found = replicates.pair_differences(query_vectors(spark, sf_dir), _MODELS, CONFIG_KEY)
    return rounded(found.select(*CONFIG_KEY, "other", "mean", "other_mean", "delta", "ci_lo", "ci_hi", "differs"))


def _isotonic_sql(direction: int) -> str:
    """Fits by the formula of greatest least means: point i of the best non-decreasing fit (of ``direction`` times the curve)."""
    inner = f"(select m.*, {direction} * y as v from pts m)"
    return f"""select {CURVE_SQL}, b, i, max(low) * {direction} as fit from (
  select p.{", p.".join(CURVE)}, p.b, p.i, s.j, min(s.mean) as low from pts p join (
    select x.{", x.".join(CURVE)}, x.b, x.i as j, z.i as k, (z.up - x.up + x.v) / (z.i - x.i + 1) as mean
    from (select *, sum(v) over (partition by {CURVE_SQL}, b order by i) as up from {inner}) x
    join (select *, sum(v) over (partition by {CURVE_SQL}, b order by i) as up from {inner}) z
      on {" and ".join(f"x.{k} = z.{k}" for k in CURVE)} and x.b = z.b and x.i <= z.i) s
  on {" and ".join(f"p.{k} = s.{k}" for k in CURVE)} and p.b = s.b and s.j <= p.i and s.k >= p.i group by all) group by {CURVE_SQL}, b, i"""


@query("curve_probabilities", _cte(f"""{_PQ}, pts as (select {CURVE_SQL}, b, cu as y, row_number() over (partition by {CURVE_SQL}, b order by {_X} desc) as i
  from pb_reps where {_X} is not null and cu is not null),
up as ({_isotonic_sql(1)}), dn as ({_isotonic_sql(-1)}),
fits as (select {", ".join("p." + k for k in CURVE)}, p.b, count(*) as n, sum((y - up.fit) * (y - up.fit)) as loss_up, sum((y - dn.fit) * (y - dn.fit)) as loss_dn,
  max(up.fit) - min(up.fit) as span_up, max(dn.fit) - min(dn.fit) as span_dn from pts p
  join up on {" and ".join(f"up.{k} = p.{k}" for k in CURVE)} and up.b = p.b and up.i = p.i
  join dn on {" and ".join(f"dn.{k} = p.{k}" for k in CURVE)} and dn.b = p.b and dn.i = p.i group by all),
named as (select {CURVE_SQL}, case when n < 2 then 'indeterminate' when loss_up < loss_dn - 1e-12 then case when span_up <= {PRACTICAL_DELTA} then 'flat' else 'rising' end
  when loss_dn < loss_up - 1e-12 then case when span_dn <= {PRACTICAL_DELTA} then 'flat' else 'falling' end
  when greatest(span_up, span_dn) <= {PRACTICAL_DELTA} then 'flat' else 'indeterminate' end as shape from fits),
labels as (select {CURVE_SQL}, count(distinct quantization) as n_points from pb where {_X} is not null group by {CURVE_SQL})
select {CURVE_SQL}, n_points, {", ".join(r6(f"count(*) filter (shape = '{p}') / 1000.0::double", f"p_{p}") for p in replicates.PATTERNS[:3])},
  {r6("1.0::double - count(*) filter (shape <> 'indeterminate') / 1000.0::double", "p_indeterminate")}
from named join labels using ({CURVE_SQL}) group by {CURVE_SQL}, n_points"""))
def _(spark, sf_dir):
    return rounded(replicates.curve_probabilities(query_vectors(spark, sf_dir), CURVE, AXIS))

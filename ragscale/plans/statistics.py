"""Aggregation, bootstrap, gap, agreement and determinism queries."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from ragscale.functions.scoring import discretize_closed, discretize_open
from ragscale.operators import agreement, aggregate, bootstrap, incremental, quality
from ragscale.plans.catalog import query, r6, rounded, table
from ragscale.plans.evalview import draws_cte, ev, eval_records, long_rows, poisson_cte
from ragscale.schemas import BOOTSTRAP_RESAMPLES, CONFIG_KEY, METRICS, PAIR_KEY

KEYS = ", ".join(CONFIG_KEY)
PAIRS = ", ".join(PAIR_KEY)
STATS = ["mean", "ci_lo", "ci_hi", "std"]
LONG = ", ".join(r6(c, c) for c in STATS)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregated study of the derived records."""
    return aggregate.aggregate_results(eval_records(spark, sf_dir), "event_id", "event_id")


PAIRED = f"""
last as (select {PAIRS}, pass, query_id, arg_max(struct_pack(v := cu), event_id).v as cu from ev
  where pass in ('pass2', 'pass3') group by {PAIRS}, pass, query_id),
pairs as (select {", ".join("a." + k for k in PAIR_KEY)}, a.query_id, a.cu as loose, b.cu as strict,
  b.cu - a.cu as preference_gap
  from last a join last b on {" and ".join(f"a.{k} = b.{k}" for k in PAIR_KEY)} and a.query_id = b.query_id
  and a.pass = 'pass2' and b.pass = 'pass3' where a.cu is not null and b.cu is not null)"""
HEADS = f"""
heads as (select {KEYS}, count(*) as n_queries, arg_min(coalesce(source, 'local'), event_id) as source,
  pass like 'pass3%' and avg(cu) < 0.3 as capability_degraded from ev group by {KEYS})"""


@cache
def results_cte(metrics: tuple[str, ...] = tuple(METRICS)) -> str:
    """CTEs ending in ``res``: the aggregated study (of some metrics, and the gap)."""
    stats = ", ".join(f"coalesce({c}, 0.0) as {c}" for c in STATS)
    return f"""{poisson_cte("ev", CONFIG_KEY, list(metrics), "event_id")}, {PAIRED},
{poisson_cte("pairs", PAIR_KEY, ["preference_gap"], "query_id", "gap")},
gap_long as ({long_rows("gap", PAIR_KEY, ["preference_gap"])}), {HEADS},
res_rows as (select {KEYS}, metric, mean, ci_lo, ci_hi, std from ({long_rows("boot", CONFIG_KEY, list(metrics))}) union all
  select {", ".join("h." + k for k in CONFIG_KEY)}, 'preference_gap' as metric, {stats} from heads h
  left join gap_long g on {" and ".join(f"h.{k} = g.{k}" for k in PAIR_KEY)} and h.pass = 'pass3'),
res as (select r.*, source, n_queries, capability_degraded from res_rows r join heads h
  on {" and ".join(f"r.{k} = h.{k}" for k in CONFIG_KEY)})"""


AGGREGATED_SQL = ev(f", {results_cte()} select {KEYS}, source, n_queries, metric, {LONG}, capability_degraded from res").replace(") ,", "),", 1)


@query("aggregate_results", AGGREGATED_SQL)
def _(spark, sf_dir):
    return rounded(results(spark, sf_dir))


_WIDE = ", ".join(f"{r6(f'avg(coalesce({m}, 0.0))', m + '_mean')}, {r6(f'coalesce(stddev_samp(coalesce({m}, 0.0)), 0.0)', m + '_std')}" for m in METRICS)


@query("config_aggregate", ev(f"""select {KEYS}, count(*) as n_queries,
  arg_min(coalesce(source, 'local'), event_id) as source, {_WIDE} from ev group by {KEYS}"""))
def _(spark, sf_dir):
    return rounded(aggregate.config_aggregate(eval_records(spark, sf_dir), "event_id"))


@query("std_n1", ev(f"""select {KEYS}, query_id, count(*) as n, {r6("avg(cu)", "cu__mean")},
  {r6("coalesce(stddev_samp(cu), 0.0)", "cu__std")} from ev group by {KEYS}, query_id"""))
def _(spark, sf_dir):
    return rounded(aggregate.metric_stats(eval_records(spark, sf_dir), [*CONFIG_KEY, "query_id"], ["cu"]))


_MQ = ["model", "quantization"]


@query("bootstrap_ci", ev(f", {poisson_cte('ev', _MQ, ['cu'], 'event_id')} select model, quantization, n, metric, {LONG} from ({long_rows('boot', _MQ, ['cu'])})").replace(") ,", "),", 1))
def _(spark, sf_dir):
    return rounded(bootstrap.poisson_ci(eval_records(spark, sf_dir), _MQ, ["cu"], "event_id"))


@query("bootstrap_all_metrics", ev(f", {poisson_cte('ev', CONFIG_KEY, METRICS, 'event_id')} select {KEYS}, n, metric, {LONG} from ({long_rows('boot', CONFIG_KEY, METRICS)})").replace(") ,", "),", 1))
def _(spark, sf_dir):
    return rounded(bootstrap.poisson_ci(eval_records(spark, sf_dir), CONFIG_KEY, METRICS, "event_id"))


@query("bootstrap_ci_exact", ev(f""",
vals as (select model, quantization, cu, row_number() over (partition by model, quantization order by event_id) - 1 as pos,
  count(*) over (partition by model, quantization) as n from ev),
{draws_cte("vals", _MQ)},
reps as (select p.model, p.quantization, b, avg(cu) as m from picked p join vals v
  on p.model = v.model and p.quantization = v.quantization and p.pos = v.pos group by 1, 2, 3),
ci as (select model, quantization, quantile_cont(m, 0.025) as ci_lo, quantile_cont(m, 0.975) as ci_hi from reps group by 1, 2),
st as (select model, quantization, count(*) as n, avg(cu) as mean, coalesce(stddev_samp(cu), 0.0) as std from ev group by 1, 2)
select st.model, st.quantization, n, 'cu' as metric, {LONG} from st join ci on st.model = ci.model and st.quantization = ci.quantization
""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    return rounded(bootstrap.multinomial_ci(eval_records(spark, sf_dir), _MQ, ["cu"], "event_id"))


@query("paired_pass_join", ev(f", {PAIRED} select {PAIRS}, query_id, {r6('loose', 'loose')}, {r6('strict', 'strict')} from pairs").replace(") ,", "),", 1))
def _(spark, sf_dir):
    return rounded(aggregate.paired_passes(eval_records(spark, sf_dir), "event_id"))


_GAP = f"{PAIRED}, {poisson_cte('pairs', PAIR_KEY, ['preference_gap'], 'query_id', 'gap')}"


@query("preference_gap", ev(f", {_GAP} select {PAIRS}, n, metric, {LONG} from ({long_rows('gap', PAIR_KEY, ['preference_gap'])})").replace(") ,", "),", 1))
def _(spark, sf_dir):
    return rounded(aggregate.preference_gap(eval_records(spark, sf_dir), "event_id"))


@query("gap_attach", ev(f""", {_GAP}, {HEADS}, gap_long as ({long_rows('gap', PAIR_KEY, ['preference_gap'])})
select {", ".join("h." + k for k in CONFIG_KEY)}, n_queries, {", ".join(r6(f"coalesce({c}, 0.0)", "gap_" + c) for c in STATS)}
from heads h left join gap_long g on {" and ".join(f"h.{k} = g.{k}" for k in PAIR_KEY)} and h.pass = 'pass3'""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    records = eval_records(spark, sf_dir)
    heads = records.groupBy(*CONFIG_KEY).agg(F.count(F.lit(1)).alias("n_queries"))
    return rounded(aggregate.attach_gap(heads, aggregate.preference_gap(records, "event_id")))


@query("capability_degraded", ev(f"""select {KEYS}, {r6("avg(cu)", "cu_mean")},
  pass like 'pass3%' and avg(cu) < 0.3 as capability_degraded from ev group by {KEYS}"""))
def _(spark, sf_dir):
    means = aggregate.config_aggregate(eval_records(spark, sf_dir), "event_id", metrics=["cu"])
    flagged = means.withColumn("capability_degraded", aggregate.degraded_flag(F.col("pass"), F.col("cu_mean")))
    return rounded(flagged.select(*CONFIG_KEY, "cu_mean", "capability_degraded"))


# --- agreement -----------------------------------------------------------------------------

# Judge A's score of a metric is compared with another score of the same record as judge B's.
SECOND = {"cu": "claim_recall", "sk": "hallucination", "faithfulness": "overall_f1"}


def judge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = eval_records(spark, sf_dir)
    b = records.select("event_id", *[F.col(second).alias(m) for m, second in SECOND.items()])
    return agreement.pair_judges(records, b, ["event_id"], list(SECOND))


def direct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores taken from one row, where a record carries them side by side."""
    cols = [c for m, s in SECOND.items() for c in (F.col(m).alias(f"{m}__a"), F.col(s).alias(f"{m}__b"))]
    return eval_records(spark, sf_dir).select("model", *cols)


def _bin(v: str, op: str, edges=(0.33, 0.66)) -> str:
    return f"case when coalesce({v}, 0.0) {op} {edges[0]} then 0 when coalesce({v}, 0.0) {op} {edges[1]} then 1 else 2 end"


def cells_cte(op: str, edges) -> str:
    rows = " union all ".join(
        f"select model as stratum, '{m}' as metric, {_bin(m, op, edges)} as a, {_bin(s, op, edges)} as b from ev"
        for m, s in SECOND.items())
    return f"cells as (select stratum, metric, a, b, count(*) as n from ({rows}) group by 1, 2, 3, 4)"


CLOSED = cells_cte("<=", (0.33, 0.66))
OPEN = cells_cte("<", (0.33, 0.67))
GROUPED = """
g as (select metric, stratum, a, b, sum(n) as n from cells group by grouping sets ((metric, a, b), (metric, stratum, a, b))),
ma as (select metric, stratum, a, sum(n) as n from g group by 1, 2, 3),
mb as (select metric, stratum, b, sum(n) as n from g group by 1, 2, 3),
tot as (select metric, stratum, sum(n) as n, sum(case when a = b then n else 0 end) as agree,
  sum(abs(a - b) / 2.0 * n) as o from g group by 1, 2),
pe as (select ma.metric, ma.stratum, sum(ma.n * mb.n) as e from ma join mb on ma.metric = mb.metric
  and ma.stratum is not distinct from mb.stratum and ma.a = mb.b group by 1, 2),
we as (select ma.metric, ma.stratum, sum(ma.n * mb.n * abs(ma.a - mb.b) / 2.0) as e from ma join mb on ma.metric = mb.metric
  and ma.stratum is not distinct from mb.stratum group by 1, 2)"""
KAPPA = """case when e / (t.n * t.n)::double >= 1 then 1.0 else
  round((agree / t.n::double - e / (t.n * t.n)::double) / (1 - e / (t.n * t.n)::double), 4) end"""


@query("judge_pairing", ev(f"select event_id, {', '.join(f'{r6(m, m + chr(95) * 2 + chr(97))}, {r6(s, m + chr(95) * 2 + chr(98))}' for m, s in SECOND.items())} from ev"))
def _(spark, sf_dir):
    return rounded(judge_pairs(spark, sf_dir))


@query("cohens_kappa", """
with g as (select quality as a, toxic as b, count(*) as n from labels group by 1, 2),
t as (select sum(n) as n, sum(case when a = b then n else 0 end) as agree from g),
e as (select sum(x.n * y.n) as e from (select a, sum(n) as n from g group by 1) x
  join (select b, sum(n) as n from g group by 1) y on x.a = y.b)
select 'quality_toxic' as metric, t.n::bigint as n, agree::bigint as agree,
  round((agree / t.n::double - coalesce(e, 0) / (t.n * t.n)::double) / (1 - coalesce(e, 0) / (t.n * t.n)::double), 4) as kappa
from t, e""")
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    cells = labels.groupBy(F.lit("quality_toxic").alias("metric"), F.col("quality").alias("a"), F.col("toxic").alias("b")).agg(
        F.count(F.lit(1)).alias("n"))
    return agreement.cohens_kappa(cells, ["metric"])


@query("kappa_by_stratum", ev(f""", {CLOSED}, {GROUPED}
select t.metric, t.stratum, t.n::bigint as n, agree::bigint as agree, {KAPPA} as kappa
from tot t join pe on t.metric = pe.metric and t.stratum is not distinct from pe.stratum""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    cells = agreement.confusion_cells(direct_pairs(spark, sf_dir), list(SECOND), ["model"])
    both = agreement.with_overall(cells.withColumnRenamed("model", "stratum"), "stratum")
    return agreement.cohens_kappa(both, ["metric", "stratum"])


@query("kappa_linear", ev(f""", {OPEN}, {GROUPED}
select t.metric, t.n::bigint as n, agree::bigint as agree,
  case when e = 0 then 1.0 else round(1 - o * t.n / e, 3) end as kappa
from tot t join we on t.metric = we.metric and t.stratum is not distinct from we.stratum where t.stratum is null""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    cells = agreement.confusion_cells(direct_pairs(spark, sf_dir), list(SECOND), bins=discretize_open)
    return agreement.linear_kappa(cells, ["metric"])


@query("raw_agreement", ev(f""", {OPEN}
select metric, sum(case when a = b then n else 0 end)::bigint as agree, sum(n)::bigint as n,
  sum(case when a = b then n else 0 end)::bigint || '/' || sum(n)::bigint as raw_agreement from cells group by 1""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    cells = agreement.confusion_cells(direct_pairs(spark, sf_dir), list(SECOND), bins=discretize_open)
    return agreement.raw_agreement(cells, ["metric"])


@query("confusion_matrix", ev(f""", {CLOSED}
select m.metric, i.i::int as a, j.j::int as b, coalesce((select sum(n) from cells c where c.metric = m.metric and c.a = i.i and c.b = j.j), 0)::bigint as n
from (select distinct metric from cells) m, range(3) i(i), range(3) j(j)""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    cells = agreement.confusion_cells(direct_pairs(spark, sf_dir), list(SECOND))
    return agreement.confusion_matrix(cells, ["metric"])


@query("judge_verdict", ev(f""", {CLOSED}, {GROUPED}
select t.metric, t.n::bigint as n, agree::bigint as agree, {KAPPA} as kappa, 0.8::double as threshold, {KAPPA} >= 0.8 as validated
from tot t join pe on t.metric = pe.metric and t.stratum is not distinct from pe.stratum where t.stratum is null""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    cells = agreement.confusion_cells(direct_pairs(spark, sf_dir), list(SECOND))
    return agreement.verdict(agreement.cohens_kappa(cells, ["metric"]))


def _bin_or_null(v: str, op: str, edges) -> str:
    return f"case when {v} is null then null when {v} {op} {edges[0]} then 0 when {v} {op} {edges[1]} then 1 else 2 end"


@query("discretize_closed", ev(f"select event_id, {_bin_or_null('sk', '<=', (0.33, 0.66))} as bin from ev"))
def _(spark, sf_dir):
    return eval_records(spark, sf_dir).select("event_id", discretize_closed(F.col("sk")).alias("bin"))


@query("discretize_open", ev(f"select event_id, {_bin_or_null('sk', '<', (0.33, 0.67))} as bin from ev"))
def _(spark, sf_dir):
    return eval_records(spark, sf_dir).select("event_id", discretize_open(F.col("sk")).alias("bin"))


_APART = "quality * 5 as a, case when doc_id % 7 = 0 then 3 else toxic * 5 end as b"


@query("kappa_label_union", f"""
with g as (select a, b, count(*) as n from (select {_APART} from labels) group by 1, 2),
l as (select a as v from g union select b from g),
x as (select v, coalesce((select sum(n) from g where a = v), 0) as na, coalesce((select sum(n) from g where b = v), 0) as nb from l),
t as (select sum(n) as n, sum(case when a = b then n else 0 end) as agree, sum(abs(a - b) * n) as o from g),
e as (select sum(na * nb) as e from x), w as (select sum(x.na * y.nb * abs(x.v - y.v)) as w from x, x y)
select 'apart' as metric, t.n::bigint as n, agree::bigint as agree,
  round((agree / t.n::double - e / (t.n * t.n)::double) / (1 - e / (t.n * t.n)::double), 4) as kappa,
  round(1 - o * t.n / w::double, 3) as linear from t, e, w""")
def _(spark, sf_dir):
    rated = table(spark, sf_dir, "labels").selectExpr("'apart' as metric", *_APART.split(", ", 1))
    cells = rated.groupBy("metric", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    linear = agreement.linear_kappa(cells, ["metric"]).select("metric", F.col("kappa").alias("linear"))
    return agreement.cohens_kappa(cells, ["metric"]).join(linear, "metric")


STUDY_SIZES = {"click": 40, "view": 60, "error": 10**9}


@query("agreement_study", ev(f""",
s as (select * from (select *, row_number() over (partition by model order by md5('42-' || cast(event_id as varchar)), event_id) as r from ev)
  where r <= case model {" ".join(f"when '{m}' then {n}" for m, n in STUDY_SIZES.items())} else 0 end),
{CLOSED.replace("from ev", "from s")}, {GROUPED}
select t.metric, t.stratum as model, t.n::bigint as n, agree::bigint as agree, {KAPPA} as kappa, 0.8::double as threshold, {KAPPA} >= 0.8 as validated
from tot t join pe on t.metric = pe.metric and t.stratum is not distinct from pe.stratum""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    records = eval_records(spark, sf_dir)
    second = records.select("event_id", *[F.col(s).alias(m) for m, s in SECOND.items()])
    return agreement.agreement_study(records, second, ["event_id"], list(SECOND), "model", STUDY_SIZES)


_HOLED = ["model", "quantization", "dataset", "subset", "pass"]
_NULLS = "nullif(quantization, 'Q4') as quantization, nullif(subset, 'noise') as subset"
_NULL_KEYS = f"nk as (select * exclude (quantization, subset), {_NULLS} from ev)"


def null_key_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived records with missing configuration keys."""
    return eval_records(spark, sf_dir).withColumns({"quantization": F.expr("nullif(quantization, 'Q4')"), "subset": F.expr("nullif(subset, 'noise')")})


@query("config_aggregate_null_keys", ev(f""", {_NULL_KEYS} select {KEYS}, count(*) as n_queries,
  arg_min(coalesce(source, 'local'), event_id) as source, {r6("avg(cu)", "cu_mean")}, {r6("coalesce(stddev_samp(cu), 0.0)", "cu_std")}
  from nk group by {KEYS}""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    return rounded(aggregate.config_aggregate(null_key_records(spark, sf_dir), ["event_id", "query_id"], metrics=["cu"]))


@query("bootstrap_ci_null_keys", ev(f""", {_NULL_KEYS}, b as (select *, coalesce(quantization, '?') as qk from nk),
{poisson_cte("b", ["model", "qk"], ["cu"], "event_id")}
select model, nullif(qk, '?') as quantization, n, metric, {LONG} from ({long_rows("boot", ["model", "qk"], ["cu"])})""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    return rounded(bootstrap.poisson_ci(null_key_records(spark, sf_dir), _MQ, ["cu"], ["event_id"]))


@query("resume_null_keys", ev(f""", {_NULL_KEYS}, w as (select distinct {KEYS}, query_id, cents from nk)
select distinct {KEYS}, query_id from w t where not exists (select 1 from w d where d.cents < 5000 and d.query_id = t.query_id
  and {" and ".join(f"d.{k} is not distinct from t.{k}" for k in _HOLED)})""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    work = null_key_records(spark, sf_dir).select(*CONFIG_KEY, "query_id", "cents")
    return incremental.remaining_work(work.drop("cents").distinct(), work.where("cents < 5000"), CONFIG_KEY)


_FLAG_ROWS = "select case when event_id % 10 < 9 then 'most' end as flag, event_id as k, value::double as v from events"


def _exact_sql(rows: str) -> str:
    """Exact bootstrap of ``flag, k, v`` rows."""
    return f"""with vals as (select flag, v, row_number() over (partition by flag order by k) - 1 as pos, count(*) over (partition by flag) as n from ({rows})),
{draws_cte("vals", ["flag"])},
reps as (select p.flag, b, avg(v) as m from picked p join vals v on p.flag is not distinct from v.flag and p.pos = v.pos group by 1, 2),
ci as (select flag, quantile_cont(m, 0.025) as ci_lo, quantile_cont(m, 0.975) as ci_hi from reps group by 1),
st as (select flag, count(*) as n, avg(v) as mean, coalesce(stddev_samp(v), 0.0) as std from vals group by 1)
select st.flag, n, 'v' as metric, {LONG} from st join ci on st.flag is not distinct from ci.flag"""


@query("bootstrap_ci_exact_large_full", _exact_sql(_FLAG_ROWS))
def _(spark, sf_dir):
    """Two groups, one of them null and one with nine tenths of the rows, in many small blocks."""
    rows = table(spark, sf_dir, "events").selectExpr("case when event_id % 10 < 9 then 'most' end as flag", "event_id as k", "double(value) as v")
    return rounded(bootstrap.multinomial_ci(rows, ["flag"], ["v"], "k", block_rows=1000))


@query("bootstrap_ci_exact_large", _exact_sql("select event_type = 'purchase' as flag, event_id as k, ln(1 + value::double) as v from events"))
def _(spark, sf_dir):
    """All purchases against all other events, in blocks of the operator's own size."""
    rows = table(spark, sf_dir, "events").selectExpr("event_type = 'purchase' as flag", "event_id as k", "log1p(double(value)) as v")
    return rounded(bootstrap.multinomial_ci(rows, ["flag"], ["v"], "k"))


# --- determinism ---------------------------------------------------------------------------

RUNS = "select user_id as query, event_id % 10 as seed, event_type as response from events"


def seed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query"), (F.col("event_id") % 10).alias("seed"), F.col("event_type").alias("response"))


@query("determinism_per_query", f"""with r as ({RUNS}), u as (select query, response, count(*) as n from r group by 1, 2)
select query, count(*) as n_unique_responses, sum(n)::bigint as n_runs,
  array_to_string(list_sort(list(response))[1:5], '|') as unique_responses from u group by 1""")
def _(spark, sf_dir):
    out = quality.determinism_per_query(seed_runs(spark, sf_dir))
    return out.withColumn("unique_responses", F.array_join("unique_responses", "|"))


@query("determinism_summary", f"""with r as ({RUNS}), u as (select query, count(distinct response) as u from r group by 1)
select sum(case when u > 1 then 1 else 0 end) = 0 as deterministic, (select count(distinct seed) from r) as n_seeds,
  count(*) as n_queries, sum(case when u > 1 then 1 else 0 end)::bigint as n_divergent_queries from u""")
def _(spark, sf_dir):
    return quality.determinism_summary(seed_runs(spark, sf_dir))


@query("dedupe_last_wins", ev(f"""select {KEYS}, query_id, max(event_id) as event_id, {r6("arg_max(struct_pack(v := cu), event_id).v", "cu")},
  {r6("arg_max(struct_pack(v := sk), event_id).v", "sk")} from ev group by {KEYS}, query_id"""))
def _(spark, sf_dir):
    rows = eval_records(spark, sf_dir).select(*CONFIG_KEY, "query_id", "event_id", "cu", "sk")
    return rounded(incremental.last_wins(rows, [*CONFIG_KEY, "query_id"], "event_id"))


@query("common_queries", ev(f"""select {PAIRS}, query_id from ev where pass = 'pass2' intersect
  select {PAIRS}, query_id from ev where pass = 'pass3'"""))
def _(spark, sf_dir):
    records = eval_records(spark, sf_dir)
    key = [*PAIR_KEY, "query_id"]
    return incremental.common_queries(records.where("pass = 'pass2'"), records.where("pass = 'pass3'"), key)

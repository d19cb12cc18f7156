"""Evaluation records derived from the events table, and SQL for their statistics.

One text defines the records for Spark and for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragscale.operators.bootstrap import BITS, HIGH, LEAF, LOW, SPLITS, WEIGHTS
from ragscale.plans.catalog import table
from ragscale.schemas import BOOTSTRAP_RESAMPLES, BOOTSTRAP_SEED, METRICS

AXIS = ["Q3", "Q4", "Q5", "Q6", "Q8", "FP16"]
# Multiplier that spreads the event value into each metric.
SPREAD = {
    "cu": 1, "sk": 7, "ns_relevant": 11, "ns_irrelevant": 13, "hallucination": 17, "faithfulness": 19,
    "overall_precision": 23, "overall_recall": 29, "overall_f1": 31, "claim_recall": 37, "context_precision": 41,
}


def _metric(m: str) -> str:
    value = f"cast((cents * {SPREAD[m]}) % 50000 as double) / cast(50000 as double)"
    if m == "sk":  # some records lack this score
        value = f"case when event_id % 97 = 0 then null else {value} end"
    return f"{value} as {m}"


EV_SQL = f"""
select event_id, ts, model,
  case q when 0 then 'Q3' when 1 then 'Q4' when 2 then 'Q5' when 3 then 'Q6' when 4 then 'Q8' else 'FP16' end
    as quantization,
  case when query_id % 11 = 0 then null when model = 'purchase' then 'api' else 'local' end as source,
  'events' as dataset,
  case sb when 0 then 'counterfactual' when 1 then 'noise' else 'rejection' end as subset,
  case when p = 0 then 'pass1' when p in (1, 3) then 'pass2' else 'pass3' end as pass,
  query_id, cents, {", ".join(_metric(m) for m in METRICS)}
from (select event_id, ts, event_type as model, event_id % 6 as q,
        cast(floor(event_id / 6) as bigint) % 5 as p, user_id % 3 as sb, user_id as query_id,
        cast(round(value * 100) as bigint) as cents
      from {{events}}) b
"""


def eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EV_SQL.format(events="{events}"), events=table(spark, sf_dir, "events"))


def ev(body: str) -> str:
    """A DuckDB query over the derived records, named ``ev``."""
    return f"with ev as ({EV_SQL.format(events='events')}) {body}"


_LINEAR = "(k1 * ca + k2 * cb + cc) % 2147483647"
_SCRAMBLED = "((h0 * h0 + 12345) % 2147483647 * ((h0 * h0 + 12345) % 2147483647) + h0) % 2147483647"


def _key_half(row_key: str, at: int) -> str:
    return f"('0x' || substr(md5(cast({row_key} as varchar)), {at}, 15))::bigint % 2147483647"


def _coefficients(lane: int, n: int, seed: int) -> str:
    """A table of the three hash coefficients of every replicate."""
    digits = lambda at: f"('0x' || substr(d, {at}, 10))::bigint"
    return f"""(select b, {digits(1)} % 2147483646 + 1 as ca, {digits(11)} % 2147483646 + 1 as cb, {digits(21)} % 2147483647 as cc
    from (select b, md5('{seed}-{lane}-' || b) as d from range({n}) t(b))) cf"""


def draws_cte(vals: str, keys: list[str], n: int = BOOTSTRAP_RESAMPLES, seed: int = BOOTSTRAP_SEED, levels: int = 5) -> str:
    """CTEs ending in ``picked``: keys, replicate and position of every draw. ``vals`` has keys and n, up to LEAF * 2**levels."""
    ks = ", ".join(keys)
    out = [f"""sizes as (select distinct {ks}, n, case when n <= {LEAF} then 0 else ceil(log2(n / {LEAF}.0))::int end as lv from {vals}),
t0 as (select {ks}, n, lv, b, 1::bigint as node, n as k from sizes, range({n}) r(b))"""]
    for level in range(levels):
        out.append(f"""w{level} as (select {ks}, n, lv, t.b, node, k, w as k1, node as k2, ca, cb, cc
  from (select *, unnest(range((k + {BITS - 1}) // {BITS})) as w from t{level} where lv > {level}) t join {_coefficients(SPLITS, n, seed)} on cf.b = t.b),
x{level} as (select *, {_SCRAMBLED} as u from (select *, {_LINEAR} as h0 from w{level})),
s{level} as (select {ks}, n, lv, b, node, k, sum(bit_count(u & ((1::bigint << least({BITS}, k - {BITS} * k1)::int) - 1)))::bigint as ones
  from x{level} group by {ks}, n, lv, b, node, k),
t{level + 1} as (select {ks}, n, lv, b, 2 * node as node, ones as k from s{level} union all select {ks}, n, lv, b, 2 * node + 1, k - ones from s{level})""")
    leaves = " union all ".join(f"select * from t{level} where lv = {level}" for level in range(levels + 1))
    out.append(f"""leaves as ({leaves}), di as (select *, unnest(range(k)) as k1, node as k2 from leaves),
dh as (select {ks}, n, lv, d.b, node, k1, k2, {_LINEAR} as h0 from di d join {_coefficients(HIGH, n, seed)} on cf.b = d.b),
du as (select {ks}, n, lv, b, node, k1, k2, {_SCRAMBLED} as hi from dh),
dl as (select {ks}, n, lv, d.b, node, hi, {_LINEAR} as h0 from du d join {_coefficients(LOW, n, seed)} on cf.b = d.b),
dv as (select {ks}, n, lv, b, node, hi, {_SCRAMBLED} as lo from dl),
picked as (select {ks}, b, ((node - (1::bigint << lv)) * n + (hi * n + lo * n // 2147483647) // 2147483647) >> lv as pos from dv)""")
    return ",\n".join(out)


def poisson_cte(src: str, keys: list[str], metrics: list[str], row_key: str, name: str = "boot",
                n: int = BOOTSTRAP_RESAMPLES, seed: int = BOOTSTRAP_SEED) -> str:
    """CTEs ending in ``name``: keys, n and per metric m_mean, m_lo, m_hi, m_std."""
    ks = ", ".join(keys)
    ms = ", ".join(f"coalesce({m}, 0.0) as {m}" for m in metrics)
    sums = ", ".join(f"sum(k * {m}) / sum(k) as {m}" for m in metrics)
    cis = ", ".join(f"quantile_cont({m}, 0.025) as {m}_lo, quantile_cont({m}, 0.975) as {m}_hi" for m in metrics)
    stats = ", ".join(f"avg({m}) as {m}_mean, coalesce(stddev_samp({m}), 0.0) as {m}_std" for m in metrics)
    on = " and ".join(f"s.{k} = c.{k}" for k in keys)
    outs = ", ".join(f"{m}_mean, {m}_lo, {m}_hi, {m}_std" for m in metrics)
    return f"""
{name}_rows as (select {ks}, {ms}, {_key_half(row_key, 1)} as k1, {_key_half(row_key, 16)} as k2 from {src}),
{name}_h0 as (select r.*, b, {_LINEAR} as h0 from {name}_rows r, {_coefficients(WEIGHTS, n, seed)}),
{name}_u as (select *, {_SCRAMBLED} as u from {name}_h0),
{name}_k as (select *, case when u < 790015084 then 0 when u < 1580030168 then 1 when u < 1975037710 then 2
    when u < 2106706891 then 3 when u < 2139624186 then 4 when u < 2146207645 then 5
    when u < 2147304888 then 6 else 7 end as k from {name}_u),
{name}_reps as (select {ks}, b, {sums} from {name}_k group by {ks}, b having sum(k) > 0),
{name}_ci as (select {ks}, {cis} from {name}_reps group by {ks}),
{name}_stats as (select {ks}, count(*) as n, {stats} from {name}_rows group by {ks}),
{name} as (select {", ".join("s." + k for k in keys)}, n, {outs}
    from {name}_stats s join {name}_ci c on {on})"""


def long_rows(src: str, keys: list[str], metrics: list[str]) -> str:
    """``boot``-like wide statistics as one row per metric."""
    ks = ", ".join(keys)
    return " union all ".join(
        f"select {ks}, n, '{m}' as metric, {m}_mean as mean, {m}_lo as ci_lo, {m}_hi as ci_hi, {m}_std as std from {src}"
        for m in metrics)

"""Scan, projection, contract, resume, sampling and streaming queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ragscale.operators import aggregate, collections, incremental, quality, sampling
from ragscale.operators.skew import spread, spread_rows
from ragscale.plans.catalog import query, r6, rounded, table
from ragscale.plans.curves import ROLES, role_table
from ragscale.plans.evalview import EV_SQL, ev, eval_records, long_rows, poisson_cte
from ragscale.plans.statistics import AGGREGATED_SQL, KEYS, PAIRS, results
from ragscale.schemas import AGGREGATED_RECORD, CONFIG_KEY, ERROR_CATEGORIES, JUDGE_NAME, METRICS, PAIR_KEY, RAW_RECORD, SCORE_FIELDS, SHORT_NAME
from ragscale.session import work_path
from ragscale.sources import collections as stored
from ragscale.sources import jsonl, lines, records, registry, store
from ragscale.streaming import ingest, intervals

_M = ", ".join(r6(m, m) for m in METRICS)


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived records in the raw record layout."""
    e = eval_records(spark, sf_dir)
    scores = F.struct(F.struct(*[F.col(SHORT_NAME[f]).alias(f) for f in SCORE_FIELDS]).alias("ragchecker"))
    no_text = F.lit(None).cast("string")
    return e.select(
        F.col("event_id").cast("string").alias("run_id"), F.col("ts").cast("string").alias("timestamp"),
        "model", "quantization", "source", no_text.alias("provider"), "dataset", "subset", "pass",
        F.lit(42).alias("seed"), F.col("query_id").cast("string").alias("query_id"),
        F.concat(F.lit("what is "), F.col("query_id").cast("string")).alias("query"),
        F.when(F.col("pass") != "pass1", F.array("model", "subset")).alias("context_chunks"),
        F.col("subset").alias("ground_truth"), F.col("model").alias("response"),
        (F.col("cents") / 100).alias("generation_time_ms"), scores.alias("scores"),
        no_text.alias("response_model"), no_text.alias("judge_model"), no_text.alias("error"),
        no_text.alias("error_detail"),
    )


@query("scan_jsonl_roundtrip", ev(f"""select event_id as run, {KEYS}, source, cast(query_id as varchar) as query_id, 42 as seed,
  case when pass = 'pass1' then 0 else 2 end as n_context, {r6("cents / 100.0::double", "generation_time_ms")}, {_M} from (
  select * replace (coalesce(sk, 0.0) as sk) from ev)"""))
def _(spark, sf_dir):
    path = work_path(spark, "raw")
    jsonl.write_jsonl(raw_records(spark, sf_dir), path, "append")
    back = jsonl.scan_jsonl(spark, path, RAW_RECORD)
    flat = aggregate.scores_to_short(back)
    n_context = F.coalesce(F.size("context_chunks"), F.lit(0))
    return rounded(flat.select(
        F.col("run_id").cast("bigint").alias("run"), *CONFIG_KEY, "source", "query_id", "seed",
        F.when(n_context < 0, 0).otherwise(n_context).alias("n_context"), "generation_time_ms", *METRICS))


@query("scan_partition_pruned", ev(f"select event_id as run, {KEYS}, {r6('cu', 'cu')} from ev where subset = 'noise'"))
def _(spark, sf_dir):
    path = work_path(spark, "parts")
    jsonl.write_jsonl(raw_records(spark, sf_dir), path, "append", ["dataset", "subset"])
    noise = jsonl.scan_partitioned(spark, path, RAW_RECORD, "events", "noise")
    return rounded(noise.select(F.col("run_id").cast("bigint").alias("run"), *CONFIG_KEY,
                                F.col("scores.ragchecker.context_utilization").alias("cu")))


@query("scan_tolerant_split", """select case when event_type = 'error' then 'rejected' else 'good' end as status,
  case when event_type <> 'error' then event_type end as event_type, count(*) as n,
  sum(case when event_type <> 'error' then user_id end)::bigint as users from events group by 1, 2""")
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    lines = records.to_json_line(events.withColumn("kind", F.col("event_type")), ["kind"])
    # the lines of error events lose their closing brace
    cut = F.when(F.col("kind") == "error", F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    path = work_path(spark, "lines")
    lines.select(cut.alias("value")).write.text(path)
    good, bad = jsonl.split_tolerant(jsonl.scan_tolerant(spark, path, events.schema, "*.txt"))
    counted = good.groupBy(F.lit("good").alias("status"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))
    rejected = bad.groupBy(F.lit("rejected").alias("status")).agg(F.count(F.lit(1)).alias("n")).select(
        "status", F.lit(None).cast("string").alias("event_type"), "n", F.lit(None).cast("bigint").alias("users"))
    return counted.unionByName(rejected)


@query("scan_numbered_lines", """select row_number() over (order by event_id) as line, case when event_type <> 'error' then event_id end as event_id,
  case when event_type = 'error' then 'docs_events_' || (row_number() over (order by event_id)) else 'e' || event_id end as sample_id from events""")
def _(spark, sf_dir):
    """Events as lines of several files, in order through all of them; every record and reject has its line."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type").withColumn("sample_id", F.expr("'e' || event_id"))
    ordered = events.repartitionByRange(8, "event_id").sortWithinPartitions("event_id")
    path = work_path(spark, "lines")
    # the lines of error events lose their closing brace
    json = F.to_json(F.struct("event_id", "sample_id"))
    cut = F.when(F.col("event_type") == "error", F.substring(json, F.lit(1), F.length(json) - 1)).otherwise(json)
    ordered.select(cut.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("sample_id", T.StringType())])
    good, bad = lines.split_numbered(lines.scan_numbered(spark, path, schema, "*.txt"))
    every = good.unionByName(bad.drop("_corrupt_record"), allowMissingColumns=True)
    # files in the order of their names follow each other; their numbers of lines are a table of one row for each file
    sizes = every.groupBy("_file").agg(F.max("_line").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(lines.file_part(1)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = every.join(F.broadcast(sizes.select("_file", before.alias("before"))), "_file").withColumn("_line", F.col("_line") + F.col("before"))
    named = lines.line_ids(every.withColumns({"dataset": F.lit("docs"), "subset": F.lit("events")}))
    return named.select(F.col("_line").alias("line"), "event_id", "sample_id")


@query("collections_built_twice", """select case when event_type <> 'error' then event_type end as subset, count(*) as n_chunks, sum(event_id)::bigint as ids,
  min(case when event_type in ('click', 'error') then 'first' else 'second' end) as build from events group by 1""")
def _(spark, sf_dir):
    """Two builds of the same collections, one of them with a null key: the second adds only what the first lacks."""
    chunks = table(spark, sf_dir, "events").select("event_id", F.expr("case when event_type <> 'error' then event_type end").alias("subset"))
    path = work_path(spark, "collections")
    stored.build_collections(chunks.where("subset = 'click' or subset is null").withColumn("build", F.lit("first")), path, ["subset"])
    every = chunks.withColumn("build", F.lit("second"))
    stored.build_collections(every, path, ["subset"])
    stored.build_collections(every, path, ["subset"])
    back = spark.read.schema(every.schema).parquet(path)
    return back.groupBy("subset").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("event_id").alias("ids"), F.min("build").alias("build"))


@query("model_dim", """select p_name || '-' || p_partkey as model, p_type as role, 'FP16, Q' || p_size as quant_list,
  u.q as quantization, u.f as file from part,
  unnest([{'q': 'FP16', 'f': p_brand || '-f16'}, {'q': 'Q' || p_size, 'f': p_brand || '-q' || p_size}]) t(u)""")
def _(spark, sf_dir):
    size = F.col("p_size").cast("string")
    quants = F.create_map(F.lit("FP16"), F.concat("p_brand", F.lit("-f16")),
                          F.concat(F.lit("Q"), size), F.concat("p_brand", F.lit("-q"), size))
    reg = table(spark, sf_dir, "part").select(
        F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("model"), F.col("p_type").alias("role"),
        quants.alias("quants"))
    return registry.model_dim(reg)


@query("raw_record_project", """select coalesce(case when o_orderstatus <> 'P' then o_orderpriority end,
    case when o_orderstatus <> 'F' then 'about ' || o_orderkey end, '') as query,
  coalesce(case when o_orderstatus = 'O' then 'q' || o_orderkey end, case when o_orderstatus = 'F' then 's' || o_orderkey end,
    case when o_custkey % 2 = 0 then 'i' || o_orderkey end, '') as query_id,
  coalesce(case when o_orderstatus = 'O' then o_orderpriority end, case when o_orderstatus = 'F' then 'answer' end, '') as ground_truth,
  coalesce(case when o_custkey % 3 > 0 then o_orderstatus end, 'default') as subset, o_orderkey as row_id, 42 as seed, 'run-1' as run_id
from orders""")
def _(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    s = lambda v: F.col("o_orderstatus") == v
    samples = table(spark, sf_dir, "orders").select(
        F.when(~s("P"), F.col("o_orderpriority")).alias("query"),
        F.when(~s("F"), F.concat(F.lit("about "), key)).alias("question"),
        F.when(s("O"), F.concat(F.lit("q"), key)).alias("query_id"),
        F.when(s("F"), F.concat(F.lit("s"), key)).alias("sample_id"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("i"), key)).alias("id"),
        F.when(s("O"), F.col("o_orderpriority")).alias("ground_truth"),
        F.when(s("F"), F.lit("answer")).alias("answer"),
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderstatus")).alias("subset"),
        F.col("o_orderkey").alias("row_id"),
    )
    return records.project_raw(samples, {"seed": 42, "run_id": "run-1"})


@query("metric_rename_default", ev(f"select event_id, {', '.join(r6(f'coalesce({m}, 0.0)' if m != 'faithfulness' else '0.0::double', m) for m in METRICS)} from ev"))
def _(spark, sf_dir):
    e = eval_records(spark, sf_dir)
    # this judge does not report faithfulness at all
    judged = e.select("event_id", *[F.col(SHORT_NAME[raw]).alias(j) for j, raw in JUDGE_NAME.items() if j != "faithfulness"])
    return rounded(aggregate.judge_to_short(judged, ["event_id"]).select("event_id", *METRICS))


@query("metric_unpivot", ev(" union all ".join(f"select event_id, '{m}' as metric, {r6(m, 'value')} from ev" for m in METRICS)))
def _(spark, sf_dir):
    return rounded(aggregate.unpivot_metrics(eval_records(spark, sf_dir), ["event_id"]))


@query("score_failure_default", ev(f"""select event_id, model, {", ".join(r6(f"case when model <> 'error' and cents % 7 > 0 then coalesce({m}, 0.0) else 0.0 end", m) for m in METRICS)},
  not (model <> 'error' and cents % 7 > 0) as is_failed from ev"""))
def _(spark, sf_dir):
    e = eval_records(spark, sf_dir)
    scored = e.where((F.col("model") != "error") & (F.col("cents") % 7 > 0))
    return rounded(quality.score_or_default(e.select("event_id", "model"), scored, ["event_id"], METRICS))


_BROKEN = {
    "missing:run_id": "cents > 40000", "missing:timestamp": "model = 'signup' and cents > 30000",
    "type:seed": "model = 'click' and cents < 3000", "type:generation_time_ms": "model = 'view' and cents < 2000",
    "type:context_chunks": "model = 'purchase' and pass = 'pass3'", "value:source": "model = 'purchase'",
    "value:pass": "pass in ('pass1', 'pass2', 'pass3')", "type:scores": "model = 'error' and cents > 20000",
    "missing:scores.self_knowledge": "event_id % 97 = 0 and not (model = 'error' and cents > 20000)",
}


@query("contract_violations", ev(" union all ".join(
    f"select '{rule}' as rule, count(*) as n from ev where {where} having count(*) > 0" for rule, where in _BROKEN.items())))
def _(spark, sf_dir):
    e = spread(eval_records(spark, sf_dir), "event_id")
    breaks = lambda rule: F.expr(_BROKEN[rule])
    field = lambda name, v: F.concat(F.lit(f'"{name}":'), v)
    quoted = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    scores = F.concat_ws(",", *[
        F.when(~breaks(f"missing:scores.{f}"), field(f, F.coalesce(F.col(SHORT_NAME[f]), F.lit(0.0)).cast("string")))
        if f"missing:scores.{f}" in _BROKEN else field(f, F.coalesce(F.col(SHORT_NAME[f]), F.lit(0.0)).cast("string"))
        for f in SCORE_FIELDS])
    parts = [
        F.when(~breaks("missing:run_id"), field("run_id", quoted("event_id"))),
        F.when(~breaks("missing:timestamp"), field("timestamp", quoted("ts"))),
        *[field(c, quoted(c)) for c in ("model", "quantization", "dataset", "subset", "pass", "query_id")],
        field("source", F.when(breaks("value:source"), F.lit('"elsewhere"')).otherwise(F.lit('"local"'))),
        field("provider", F.lit("null")),
        field("seed", F.when(breaks("type:seed"), F.lit('"many"')).otherwise(F.lit("42"))),
        field("query", F.lit('"q"')), field("ground_truth", F.lit('"g"')), field("response", F.lit('"r"')),
        field("context_chunks", F.when(breaks("type:context_chunks"), F.lit('"text"'))
              .when(F.col("pass") == "pass1", F.lit("null")).otherwise(F.lit('["a","b"]'))),
        field("generation_time_ms", F.when(breaks("type:generation_time_ms"), F.lit('"soon"')).otherwise(F.col("cents").cast("string"))),
        field("scores", F.when(breaks("type:scores"), F.lit('"none"')).otherwise(
            F.concat(F.lit('{"ragchecker":{'), scores, F.lit("}}")))),
    ]
    lines = e.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("line"))
    return quality.violation_counts(quality.raw_violations(lines))


_SPOILT = {  # which derived aggregates are spoilt, and how
    "missing:model": "h % 11 = 0", "type:n_queries": "h % 13 = 0", "value:n_queries": "h % 13 <> 0 and h % 17 = 0",
    "missing:metrics.sk": "h % 7 = 0", "unknown:metrics.speed": "h % 5 = 0", "stats:cu": "h % 3 = 0", "order:cu": "h % 3 = 1 and h % 2 = 0",
}
_HASHED = "user_id % 100003 as h"


@query("aggregated_violations", f"with u as (select {_HASHED} from events) " + " union all ".join(
    f"select '{rule}' as rule, count(*) as n from u where {when} having count(*) > 0" for rule, when in _SPOILT.items()))
def _(spark, sf_dir):
    def stat(mean: str) -> str:
        return f'{{"mean":{mean},"ci_lo":0.25,"ci_hi":0.75,"std":0.125}}'

    breaks = lambda rule: F.expr(_SPOILT[rule])
    metrics = [F.concat(F.lit(f'"{m}":'), F.lit(stat("0.5"))) for m in [*METRICS, "preference_gap"] if m not in ("cu", "sk")]
    cu = F.when(breaks("stats:cu"), F.lit(stat("null"))).when(breaks("order:cu"), F.lit(stat("0.875"))).otherwise(F.lit(stat("0.5")))
    metrics += [
        F.concat(F.lit('"cu":'), cu), F.when(~breaks("missing:metrics.sk"), F.lit('"sk":' + stat("0.5"))),
        F.when(breaks("unknown:metrics.speed"), F.lit('"speed":' + stat("0.5"))),
    ]
    parts = [
        F.when(~breaks("missing:model"), F.lit('"model":"m"')), F.lit('"quantization":"Q4","source":"local","dataset":"d","subset":"s","pass":"pass1"'),
        F.concat(F.lit('"n_queries":'), F.when(breaks("type:n_queries"), F.lit('"several"')).when(breaks("value:n_queries"), F.lit("0")).otherwise(F.lit("9"))),
        F.concat(F.lit('"metrics":{'), F.concat_ws(",", *metrics), F.lit("}")), F.lit('"capability_degraded":false'),
    ]
    hashed = spread_rows(table(spark, sf_dir, "events"), "event_id").selectExpr(_HASHED)
    lines = hashed.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("line"))
    return quality.violation_counts(quality.aggregated_record_violations(lines))


@query("aggregated_roundtrip", AGGREGATED_SQL)
def _(spark, sf_dir):
    path = work_path(spark, "aggregated")
    jsonl.write_jsonl(aggregate.nest_aggregated(results(spark, sf_dir)), path, "overwrite")
    rows = aggregate.unnest_aggregated(jsonl.scan_jsonl(spark, path, AGGREGATED_RECORD))
    return rounded(rows)


_ERR = "case when model = 'error' then case cents % 6 " + " ".join(
    f"when {i} then '{c}'" for i, c in enumerate(ERROR_CATEGORIES)) + " end end"


@query("error_census", ev(f""", c as (select {KEYS}, {_ERR} as error from ev),
t as (select {KEYS}, count(*) as n_records from c group by {KEYS})
select {", ".join("c." + k for k in CONFIG_KEY)}, error, count(*) as n, n_records, {r6("count(*) / n_records::double", "rate")}
from c join t on {" and ".join(f"c.{k} = t.{k}" for k in CONFIG_KEY)} where error is not null
group by {", ".join("c." + k for k in CONFIG_KEY)}, error, n_records""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    return rounded(quality.error_census(eval_records(spark, sf_dir).withColumn("error", F.expr(_ERR))))


_ID = "case when query_id = 7 then '' else cast(query_id as {t}) end"


@query("resume_antijoin", ev(f""", w as (select distinct {KEYS}, {_ID.format(t="varchar")} as query_id, cents from ev)
select distinct {KEYS}, query_id from w t where not exists (select 1 from w d where d.cents < 5000 and d.query_id <> ''
  and d.query_id = t.query_id and {" and ".join(f"d.{k} = t.{k}" for k in CONFIG_KEY)})""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    work = eval_records(spark, sf_dir).withColumn("query_id", F.expr(_ID.format(t="string")))
    todo = work.select(*CONFIG_KEY, "query_id").distinct()
    return incremental.remaining_work(todo, work.where("cents < 5000"), CONFIG_KEY)


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study's records as a bucketed table, written by the first query that asks for it in an application."""
    name = "records_" + hashlib.md5(f"{sf_dir}-{spark.sparkContext.applicationId}".encode()).hexdigest()
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return store.store_records(eval_records(spark, sf_dir).drop("source", "ts"), name, work_path(spark, "records"), buckets=8)


@query("stored_resume", ev(f""", w as (select distinct {KEYS}, query_id from ev)
select {KEYS}, query_id from w t where not exists (select 1 from ev d where d.query_id = t.query_id
  and {" and ".join(f"d.{k} = case when '{k}' = 'pass' and t.pass = 'pass1' then 'pass2' else t.{k} end" for k in CONFIG_KEY)})""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    """Planned work: every stored query once more, first passes as second ones; what is stored isn't done again."""
    work = eval_records(spark, sf_dir).select(*CONFIG_KEY, "query_id").distinct()
    planned = work.withColumn("was", F.col("pass")).withColumn("pass", F.when(F.col("pass") == "pass1", "pass2").otherwise(F.col("pass")))
    left = store.remaining_of_store(planned, stored_records(spark, sf_dir))
    return left.withColumn("pass", F.col("was")).select(*CONFIG_KEY, "query_id")


@query("stored_pairs", ev(f""", last as (select {PAIRS}, pass, query_id, arg_max(struct_pack(v := cu), event_id).v as cu from ev
  where pass in ('pass2', 'pass3') group by {PAIRS}, pass, query_id)
select {", ".join("a." + k for k in PAIR_KEY)}, a.query_id, {r6("a.cu", "loose")}, {r6("b.cu", "strict")}, {r6("b.cu - a.cu", "preference_gap")}
from last a join last b on {" and ".join(f"a.{k} = b.{k}" for k in PAIR_KEY)} and a.query_id = b.query_id and a.pass = 'pass2' and b.pass = 'pass3'
where a.cu is not null and b.cu is not null""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    return rounded(store.stored_pairs(stored_records(spark, sf_dir), "event_id", "pass2", "pass3"))


@query("stored_last_wins", ev(f"""select {KEYS}, query_id, max(event_id) as event_id, {r6("arg_max(struct_pack(v := cu), event_id).v", "cu")}
  from ev group by {KEYS}, query_id"""))
def _(spark, sf_dir):
    last = store.last_stored(stored_records(spark, sf_dir), [*CONFIG_KEY, "query_id"], "event_id")
    return rounded(last.select(*CONFIG_KEY, "query_id", "event_id", "cu"))


@query("role_lookup", ev(f""", {ROLES} select e.model, coalesce(role, 'unknown') as role, count(*) as n
from ev e left join roles r on e.model = r.model group by 1, 2""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    tagged = registry.with_role(eval_records(spark, sf_dir), role_table(spark, sf_dir))
    return tagged.groupBy("model", "role").agg(F.count(F.lit(1)).alias("n"))


_CATALOG = """cat as (select s_name, n_name, r_name, r_name || '_' || n_name || '_' || s_name as core,
  'idx_' || r_name || '_' || n_name || '_' || s_name || '_300w_' || substr(md5(s_name), 1, 8) as actual
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


@query("resolve_collection", f"""with {_CATALOG},
names as (select s_name as name from cat union select n_name from cat union select r_name from cat union
  select actual from cat where r_name = 'ASIA' union select core from cat where r_name = 'EUROPE' union
  select distinct p_brand from part),
hits as (select n.name, (select min(actual) from cat where actual = n.name) as exact,
  (select min(actual) from cat where core = n.name) as core,
  (select count(*) from cat where contains(actual, '_' || n.name || '_')) as k,
  (select min(actual) from cat where contains(actual, '_' || n.name || '_')) as inn from names n)
select name, coalesce(exact, core, case when k = 1 then inn end) as actual,
  case when exact is not null then 'exact' when core is not null then 'core' when k = 1 then 'inner' when k > 1 then 'ambiguous'
  else 'unknown' end as rule from hits""")
def _(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    cat = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "s_name", "n_name", "r_name", F.concat_ws("_", "r_name", "n_name", "s_name").alias("core"))
    cat = cat.withColumn("actual", F.concat(F.lit("idx_"), "core", F.lit("_300w_"), F.substring(F.md5("s_name"), 1, 8)))
    names = sampling.union_all(
        *[cat.select(F.col(c).alias("name")) for c in ("s_name", "n_name", "r_name")],
        cat.where("r_name = 'ASIA'").select(F.col("actual").alias("name")),
        cat.where("r_name = 'EUROPE'").select(F.col("core").alias("name")),
        table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")),
    )
    return collections.resolve_collections(names, cat.select("actual"), prefix="idx_")


@query("experiment_grid", """with q as (select s_suppkey as query_id, r_name as subset from supplier
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
c as (select distinct p_brand as model, p_type as quantization from part)
select query_id, subset, model, quantization, p.pass from q, c, unnest(case when subset = 'AFRICA'
  then ['pass1_baseline', 'pass2_loose', 'pass3_strict'] else ['pass2_loose'] end) p(pass)""")
def _(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    queries = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("s_suppkey").alias("query_id"), F.col("r_name").alias("subset"))
    configs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.col("p_type").alias("quantization")).distinct()
    policy = registry.pass_policy(spark, {"AFRICA": ["pass1_baseline", "pass2_loose", "pass3_strict"]})
    return incremental.experiment_grid(queries, configs, policy, ["pass2_loose"])


@query("limit_prefix", "select doc_id, source, n_chars from documents order by doc_id limit 100")
def _(spark, sf_dir):
    return sampling.prefix(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["doc_id"], 100)


_SIZES = {"primary": 250, "secondary": 50}


@query("stratified_sample", ev(f""", {ROLES}, r as (select e.event_id, e.model, role,
  row_number() over (partition by role order by md5('42-' || event_id), event_id) as n from ev e join roles r on e.model = r.model)
select event_id, model, role from r where (role = 'primary' and n <= 250) or (role = 'secondary' and n <= 50)""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    tagged = registry.with_role(eval_records(spark, sf_dir).select("event_id", "model"), role_table(spark, sf_dir))
    return sampling.stratified_sample(tagged, "role", _SIZES, ["event_id"])


@query("seeded_take", """with u as (select 'orders' as source_file, o_orderkey as record_id from orders
  union all select 'events', event_id from events)
select * from u order by md5('42-' || source_file || '-' || record_id), source_file, record_id limit 500""")
def _(spark, sf_dir):
    frames = {
        "orders": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id")),
        "events": table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id")),
    }
    return sampling.seeded_take(frames, 500, ["record_id"])


@query("union_strata", ev(f""", {ROLES} select event_id, e.model, role from ev e join roles r on e.model = r.model where role = 'primary'
  union all select event_id, e.model, role from ev e join roles r on e.model = r.model where role = 'secondary'""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    tagged = registry.with_role(eval_records(spark, sf_dir).select("event_id", "model"), role_table(spark, sf_dir))
    return sampling.union_all(tagged.where("role = 'primary'"), tagged.where("role = 'secondary'"))


@query("json_roundtrip", "select event_id, user_id, event_type, cast(props->>'k' as bigint) as k from events")
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.from_json("props", "k bigint").alias("props"))
    back = records.from_json_line(records.to_json_line(events), events.schema)
    return back.select("event_id", "user_id", "event_type", "props.k")


def records_delivered_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study's records as a stream in which every record arrives twice, as after a restart that repeats its last batch."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    twice = stream.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return spark.sql(EV_SQL.format(events="{events}"), events=twice).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_bootstrap_ci", ev(f""", {poisson_cte("ev", CONFIG_KEY, ["cu", "sk"], "event_id")}
select {KEYS}, n, metric, {", ".join(r6(c, c) for c in ("mean", "ci_lo", "ci_hi", "std"))} from ({long_rows("boot", CONFIG_KEY, ["cu", "sk"])})""").replace(") ,", "),", 1))
def _(spark, sf_dir):
    """Intervals of records as they arrive, from states that are added up, against the bootstrap over all records at once."""
    found = records_delivered_twice(spark, sf_dir)
    states = intervals.running_sums(found, ["event_id"], metrics=["cu", "sk"], late_after="30 days", event_time="ts")
    return rounded(intervals.drain_intervals(states, found, metrics=["cu", "sk"]))


@query("stream_config_aggregate", ev(f"""select {KEYS}, count(*) as n_queries, {r6("avg(cu)", "mean")},
  {r6("coalesce(stddev_samp(cu), 0.0)", "std")} from ev group by {KEYS}"""))
def _(spark, sf_dir):
    found = records_delivered_twice(spark, sf_dir)
    # re-deliveries come with the same batch or the next; older keys leave the state
    return rounded(ingest.drain(ingest.running_stats(found, ["query_id", "event_id"], late_after="30 days", event_time="ts")))

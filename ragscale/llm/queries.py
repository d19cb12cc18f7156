"""Thin queries over the operators of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ragscale.plans.catalog import r6, rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragscale.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op7_winnowing")
def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragscale.llm.winnow import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragscale.llm.simhash import fingerprint_hex, near_duplicates

    rows = near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", fingerprint_hex("fp").alias("fingerprint"), "component_id")


_BASE32 = "||".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(h), {5 * i + 1}, 5))::bigint >> {shift}) & 31)::int + 1, 1)"
    for i in range(8) for shift in (15, 10, 5, 0)
)


@query("op9_warc", f"""
with p as (select page_id, coalesce(html, '') as h from pages),
     d as (select page_id, h, max(page_id) over (partition by h) as largest from p)
select page_id, strlen(h)::bigint as payload_bytes, {_BASE32} as payload_digest,
       case when page_id is not distinct from largest then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from largest then largest end as refers_to
from d""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragscale.llm.warc import archive_folder, archive_round_trip

    columns = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    back = archive_round_trip(table(spark, sf_dir, "pages"), archive_folder(spark), columns=columns)
    return back.select("page_id", *columns[1:])


@query("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragscale.llm.mixing import mix_sizes

    return mix_sizes(table(spark, sf_dir, "documents"), weights=[1, 2, 3], most=3)


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragscale.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op1_language_mixture")
def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragscale.llm.language import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out("doc_id")))
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return identify(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "languages")


@query("op3_fertility")
def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragscale.llm.fertility import learned_rules

    return learned_rules(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json"), ["doc_id"])


_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op10_stupid_backoff", f"""
with t as (select doc_id, {_SPLIT} as ws from documents),
     e as (select doc_id, i, ws[i] as a, case when i > 1 then ws[i - 1] end as b, case when i > 2 then ws[i - 2] end as c
           from t, unnest(range(1, len(ws) + 1)) as u(i)),
     k as (select *, count(*) over (partition by a) - count(*) over (partition by doc_id, a) as c1,
                  count(*) over (partition by b, a) - count(*) over (partition by doc_id, b, a) as c2,
                  count(*) over (partition by c, b, a) - count(*) over (partition by doc_id, c, b, a) as c3,
                  count(*) over () - count(*) over (partition by doc_id) as rest from e),
     p as (select *, lag(c1) over (partition by doc_id order by i) as p1, lag(c2) over (partition by doc_id order by i) as p2 from k),
     s as (select doc_id, case when i > 2 and c3 > 0 then 3 when i > 1 and c2 > 0 then 2 when c1 > 0 then 1 else 0 end as used,
                  least(i, 3) as top, c1, c2, c3, p1, p2, rest from p),
     v as (select doc_id, used, ln(0.4) * (top - used)
                  + case used when 3 then ln(c3 / p2) when 2 then ln(c2 / p1) when 1 then ln(c1 / rest) else -ln(greatest(rest, 1)) end as value from s)
select t.doc_id, count(used) as n_words, count(*) filter (used = 3) as n_3, count(*) filter (used = 2) as n_2, count(*) filter (used = 1) as n_1,
       count(*) filter (used = 0) as n_unseen, {r6("avg(value)", "score")}
from t left join v using (doc_id) group by t.doc_id""")
def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragscale.llm.backoff import backoff_scores

    return rounded(backoff_scores(table(spark, sf_dir, "documents"), ["doc_id"]))


@query("op4_cotraining")
def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragscale.llm import cotrain

    docs = table(spark, sf_dir, "documents")
    scorer = cotrain.learn(docs, table(spark, sf_dir, "labels"))
    return cotrain.score(docs, scorer, ["doc_id"])


_INTEGERS = """v as (select vec_id, {label} as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where {there} embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)"""
_SCORES = """s as (select q.vec_id as q, q.label as q_label, c.vec_id as c, c.label as c_label,
  coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::bigint as score
  from v q, v c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)"""


@query("op11_hard_negatives", f"""
with {_INTEGERS.format(label="case when vec_id % 7 = 0 then (label + 1) % 10 else label end", there="label is not null and")}, {_SCORES},
p as (select * from s where q_label = c_label qualify row_number() over (partition by q order by score desc, c) <= 5),
n as (select p.q as anchor_id, p.c as positive_id, p.score as positive_score, s.c as negative_id, s.score as negative_score,
  row_number() over (partition by p.q, p.c order by s.score desc, s.c) as rank
  from p join s on s.q = p.q and s.c_label <> s.q_label and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragscale.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(vectors, vectors.where(F.col("vec_id") % 50 == 0))


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@query("op12_fill_in_middle", f"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_UNIT}') as u,
       sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
     n as (select *, len(u)::bigint as n, {", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::bigint as h{i + 1}" for i in range(4))} from d),
     c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
       case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
         when h4 % 100 < 80 then 'spm' else 'psm' end as form from n),
     t as (select *, coalesce(array_to_string(u[1 : lo], ''), '') as p, coalesce(array_to_string(u[lo + 1 : hi], ''), '') as m,
       coalesce(array_to_string(u[hi + 1 : n], ''), '') as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256 from t""")
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragscale.llm.middle import fill_in_middle, restored_texts

    made = fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"])
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    back = restored_texts(made.withColumn("output_sha256", F.sha2("output", 256)), [*columns, "output_sha256"])
    return back.select(*columns, "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


@query("op13_exact_topk", f"""
with {_INTEGERS.format(label="0", there="")}, {_SCORES}
select q as query_id, (row_number() over (partition by q order by score desc, c))::int as rank, c as vec_id, score from s
qualify row_number() over (partition by q order by score desc, c) <= 5""")
def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragscale.llm.search import exact_topk

    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors.where(F.col("vec_id") % 50 == 0), vectors)

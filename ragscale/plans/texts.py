"""Chunking, prompt, retrieval and claim queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ragscale.functions.hashing import content_digest, stable_key
from ragscale.functions.text import (
    NON_TOKEN, SENTENCE_END, WHITESPACE, chunk_count, chunk_words, format_context, is_blank, word_count,
    words,
)
from ragscale.operators import alignment, chunking, claims, context, incremental, lexical, prompts, vector_index, vectors, word_index
from ragscale.operators.skew import spread
from ragscale.plans.catalog import query, r6, rounded, table
from ragscale.schemas import PROMPTS, SCORE_FIELDS
from ragscale.session import work_dir, work_path


def _words_sql(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{WHITESPACE}+'), lambda x: x <> '')"


def _tokens_sql(t: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({t}), '{NON_TOKEN}'), lambda x: x <> '')"


def _blank_sql(t: str) -> str:
    return f"regexp_replace({t}, '{WHITESPACE}+', '', 'g') = ''"


def _chunks_sql(src: str, keys: str, size: int, overlap: int) -> str:
    """CTE body: keys, i, text of every chunk."""
    step = max(1, size - overlap)
    return f"""select {keys}, i, case when n <= {size} then text
    else array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') end as chunk
  from (select {keys}, text, w, len(w) as n from (select {keys}, text, {_words_sql('text')} as w from {src})),
    unnest(range(case when n = 0 then 0 when n <= {size} then 1 else 1 + (n - {size} + {step} - 1) // {step} end)) t(i)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole documents at the study's chunk size."""
    cut = chunking.chunk_passages(documents(spark, sf_dir).select("doc_id", "source", "text"))
    chunk_id = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    return cut.select("doc_id", "source", chunk_id.alias("chunk_id"), "chunk_index", "text")


DOC_CHUNKS = f"dc as (select doc_id || '_' || i as chunk_id, doc_id, i, chunk as text from ({_chunks_sql('documents', 'doc_id', 300, 64)}))"


@query("chunk_text", f"with {DOC_CHUNKS} select doc_id, i as chunk_index, length(text) as n_chars, md5(text) as digest from dc")
def _(spark, sf_dir):
    return doc_chunks(spark, sf_dir).select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("word_count", f"select doc_id, len({_words_sql('text')}) as n_words from documents")
def _(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", word_count("text").cast("bigint").alias("n_words"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as normalized samples: lines are passages, french ones also carry a knowledge text."""
    meta = F.struct(F.split("text", "\n").alias("original_passages"),
                    F.when(F.col("lang") == "fr", F.col("text")).alias("knowledge"))
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("sample_id"), F.lit("docs").alias("dataset"), F.col("source").alias("subset"),
        meta.alias("metadata"))


PASSAGES = f"""
parts as (select doc_id, source, lang, text, list_filter(regexp_split_to_array(text, '\\n'), lambda p: not {_blank_sql('p')}) as ps from documents),
psg as (select doc_id, source, unnest(range(len(ts))) as passage, unnest(ts) as text from (select doc_id, source,
  case when lang = 'fr' and not {_blank_sql('text')} then list_append(ps, text) else ps end as ts from parts))"""


@query("extract_passages", f"with {PASSAGES} select doc_id as sample_id, passage, length(text) as n_chars, md5(text) as digest from psg")
def _(spark, sf_dir):
    out = chunking.extract_passages(samples(spark, sf_dir))
    return out.select("sample_id", F.col("passage").cast("bigint").alias("passage"),
                      F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("chunk_numbering", f"""with {PASSAGES}, c as (select doc_id, source, passage, i, chunk
  from ({_chunks_sql("psg", "doc_id, source, passage", 40, 10)}))
select 'docs' as dataset, source as subset, doc_id as sample_id, passage, i as chunk_index,
  doc_id || '_chunk_' || (row_number() over (partition by source order by doc_id, passage, i) - 1) as chunk_id,
  md5(chunk) as digest from c""")
def _(spark, sf_dir):
    passages = chunking.extract_passages(samples(spark, sf_dir))
    out = chunking.number_chunks(passages, size=40, overlap=10)
    return out.select("dataset", "subset", "sample_id", F.col("passage").cast("bigint").alias("passage"),
                      F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_id", F.md5("text").alias("digest"))


_SAMPLE = "case when doc_id % 5 = 0 then {blank} else cast(doc_id as {t}) end"
_FILLED = f"""ids as (select source, text, coalesce({_SAMPLE.format(blank="null", t="varchar")},
  'docs_' || source || '_' || substr(sha256(cast(doc_id as varchar)), 1, 16)) as sample_id from documents)"""


@query("chunk_numbering_null_ids", f"""with {_FILLED}, c as (select sample_id, source, i, chunk from ({_chunks_sql("ids", "sample_id, source", 300, 64)}))
select source as subset, sample_id, i as chunk_index,
  sample_id || '_chunk_' || (row_number() over (partition by source order by sample_id, i) - 1) as chunk_id from c""")
def _(spark, sf_dir):
    rows = documents(spark, sf_dir).select(
        F.lit("docs").alias("dataset"), F.col("source").alias("subset"), "doc_id", "text", F.lit(0).alias("passage"),
        F.expr(_SAMPLE.format(blank="if(doc_id % 2 = 0, null, ' ')", t="string")).alias("sample_id"))
    out = chunking.number_chunks(chunking.sample_ids(rows, ["doc_id"]).drop("doc_id"))
    return out.select("subset", "sample_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_id")


@query("index_build_plan", f"""with n as (select doc_id, source, len({_words_sql('text')}) as w from documents),
have as (select distinct source from documents d join labels l on d.doc_id = l.doc_id where toxic = 1 and quality = 0)
select 'docs' as dataset, n.source as subset,
  sum(case when w = 0 then 0 when w <= 300 then 1 else 1 + (w - 300 + 235) // 236 end)::bigint as n_chunks,
  case when any_value(h.source) is not null then 'skip_existing' else 'build' end as action
from n left join have h on n.source = h.source group by n.source""")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = docs.select(F.lit("docs").alias("dataset"), F.col("source").alias("subset"),
                        chunk_count(word_count("text"), 300, 64).cast("bigint").alias("n_chunks"))
    labels = table(spark, sf_dir, "labels").where("toxic = 1 and quality = 0")
    existing = docs.join(labels, "doc_id").select(F.lit("docs").alias("dataset"), F.col("source").alias("subset"))
    return incremental.collection_plan(found, existing, ["dataset", "subset"])


@query("format_context", f"""with {DOC_CHUNKS} select doc_id,
  md5(coalesce(array_to_string(list(text order by i), chr(10) || chr(10)), '')) as digest, count(*) as n_chunks from dc group by 1""")
def _(spark, sf_dir):
    split = documents(spark, sf_dir).select("doc_id", "text", words("text").alias("_w"))
    cut = split.where(~is_blank("text")).select("doc_id", chunk_words(F.col("text"), 300, 64, F.col("_w")).alias("chunks"))
    return cut.select(
        "doc_id", F.md5(format_context("chunks")).alias("digest"), F.size("chunks").cast("bigint").alias("n_chunks"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the texts right before and after it."""
    t = table(spark, sf_dir, "conversations")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return t.join(before, ["conv_id", "turn"], "left").join(after, ["conv_id", "turn"], "left")


TURNS = """tn as (select t.*, b.text as before, a.text as after from conversations t
  left join conversations b on t.conv_id = b.conv_id and b.turn = t.turn - 1
  left join conversations a on t.conv_id = a.conv_id and a.turn = t.turn + 1)"""
_PASS = "case role when 'user' then case turn % 3 when 0 then 'pass1_baseline' when 1 then 'pass2_loose' else 'pass3_strict' end " \
        "when 'assistant' then 'pass3_strict' else 'pass4' end"


def _messages_sql() -> str:
    ctx = "array_to_string(ctx, chr(10) || chr(10))"
    cases = []
    for p in PROMPTS:
        body = "'" + p["user"].replace("'", "''") + "'"
        # the inserted texts are spliced in by position, not searched again
        for hole, value in (("{query}", "text"), ("{context}", ctx)):
            body = body.replace(hole, f"' || {value} || '")
        system = f"'system:' || '{p['system']}' || chr(10) || " if p["system"] else ""
        need = " and len(ctx) > 0" if p["include_context"] else ""
        cases.append(f"when pass = '{p['pass']}'{need} then md5({system}'user:' || {body})")
    return "case " + " ".join(cases) + " end"


@query("build_messages", f"""with {TURNS}, m as (select conv_id, turn, text, {_PASS} as pass,
  list_filter([before, after], lambda x: x is not null) as ctx from tn)
select conv_id, turn, pass, {_messages_sql()} as digest,
  case when pass = 'pass4' then 'unknown_pass' when pass <> 'pass1_baseline' and len(ctx) = 0 then 'missing_context' end as reject_reason
from m""")
def _(spark, sf_dir):
    rows = turns(spark, sf_dir).select(
        "conv_id", "turn", F.col("text").alias("query"), F.expr(_PASS).alias("pass"),
        F.array_compact(F.array("before", "after")).alias("context_chunks"))
    built = prompts.build_messages(rows)
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return built.select("conv_id", "turn", "pass", F.md5(flat).alias("digest"), "reject_reason")


@query("conversation_messages", """select conv_id, turn // 64 as page, count(*) as n_messages,
  md5(array_to_string(list(role || ':' || text order by turn), chr(10))) as digest from conversations group by 1, 2""")
def _(spark, sf_dir):
    lists = prompts.transcript_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return lists.select("conv_id", "page", F.size("messages").cast("bigint").alias("n_messages"), F.md5(flat).alias("digest"))


@query("content_fingerprint", """select source, count(*) as n_docs,
  cast(sum(('0x' || substr(md5(sha256(text)), 1, 15))::bigint % 1000000007)::bigint as varchar) as table_digest,
  min(sha256(text)) as first_sha, max(sha256(text)) as last_sha from documents group by 1""")
def _(spark, sf_dir):
    rows = documents(spark, sf_dir).select("source", content_digest("text").alias("sha"))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(stable_key("sha") % 1000000007).cast("string").alias("table_digest"),
        F.min("sha").alias("first_sha"), F.max("sha").alias("last_sha"))


# --- retrieval -----------------------------------------------------------------------------

def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"


def _topk_sql(by_label: bool) -> str:
    same = "where q.label = c.label" if by_label else ""
    norm = "sqrt(" + _dot("embedding", "embedding") + ")"
    return f"""with e as (select *, {norm} as len from embeddings),
s as (select q.vec_id as query_id, c.vec_id as chunk_id, round({_dot("q.embedding", "c.embedding")} / (q.len * c.len), 9) as score
  from e q, e c {same}),
r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s)
select query_id, chunk_id, {r6("score", "score")}, rank::int as rank from r where rank <= 5"""


def vector_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = spread(table(spark, sf_dir, "embeddings"), "vec_id")
    return (e.select(F.col("vec_id").alias("query_id"), "label", "embedding"),
            e.select(F.col("vec_id").alias("chunk_id"), "label", "embedding"))


@query("topk_retrieval", _topk_sql(False))
def _(spark, sf_dir):
    queries, chunks = vector_sides(spark, sf_dir)
    return rounded(vectors.topk_vectors(queries, chunks).select("query_id", "chunk_id", "score", "rank"))


@query("topk_retrieval_by_collection", _topk_sql(True))
def _(spark, sf_dir):
    queries, chunks = vector_sides(spark, sf_dir)
    found = vectors.topk_vectors(queries, chunks, by=["label"], cells=8)
    return rounded(found.select("query_id", "chunk_id", "score", "rank"))


@query("topk_retrieval_null_vectors", _topk_sql(False).replace("from embeddings)", "from embeddings where vec_id % 9 <> 0)"))
def _(spark, sf_dir):
    holed = F.when(F.col("vec_id") % 9 != 0, F.col("embedding"))
    queries, chunks = (side.withColumnRenamed(key, "vec_id").withColumn("embedding", holed).withColumnRenamed("vec_id", key)
                       for side, key in zip(vector_sides(spark, sf_dir), ("query_id", "chunk_id")))
    return rounded(vectors.topk_vectors(queries, chunks, cells=5).select("query_id", "chunk_id", "score", "rank"))


CELLS, PROBES = 16, 12  # a recall of 0.92 on vectors without any structure


def _ann_sql() -> str:
    """Pivots by md5 order, every chunk in its nearest pivot's cell, every query in the cells of its nearest pivots."""
    unit = "list_transform(embedding, lambda x: x::double / len)"
    apart = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    norm = "sqrt(" + _dot("embedding", "embedding") + ")"
    return f"""with u as (select vec_id, {unit} as v from (select *, {norm} as len from embeddings)),
p as (select row_number() over (order by ('0x' || substr(md5(cast(vec_id as varchar)), 1, 15))::bigint, vec_id) - 1 as cell, v from u
  qualify cell < {CELLS}),
d as (select u.vec_id, p.cell, row_number() over (partition by u.vec_id order by round({apart("u.v", "p.v")}, 12), p.cell) as near from u, p),
s as (select q.vec_id as query_id, c.vec_id as chunk_id, round({_dot("q.v", "c.v")}, 9) as score from u q, u c),
e as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from s qualify r <= 5),
a as (select s.* from s join d c on c.vec_id = s.chunk_id and c.near = 1 join d q on q.vec_id = s.query_id and q.cell = c.cell and q.near <= {PROBES}),
n as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from a qualify r <= 5)
select e.query_id, count(*) as n_exact, count(n.chunk_id) as n_found, {r6("count(n.chunk_id) / count(*)::double", "recall")}
from e left join n on n.query_id = e.query_id and n.chunk_id = e.chunk_id group by 1"""


@query("topk_ann_recall", _ann_sql())
def _(spark, sf_dir):
    queries, chunks = vector_sides(spark, sf_dir)
    exact = vectors.topk_vectors(queries, chunks)
    near = vectors.topk_vectors(queries, chunks, cells=CELLS, nprobe=PROBES)
    return rounded(vectors.recall_at_k(exact, near, "query_id", "chunk_id"))


@query("topk_index_recall")
def _(spark, sf_dir):
    """Recall of the stored index, which ranks a tenth of the vectors exactly; no SQL, because its centres are fitted."""
    queries, chunks = vector_sides(spark, sf_dir)
    path = work_path(spark, "vector-index")
    vector_index.build_index(chunks, path, cells=CELLS)
    near = vector_index.search_index(queries, path, nprobe=CELLS - 1, candidates=100)
    read = near.groupBy("query_id").agg(F.max("n_read").alias("n_read"))
    found = vectors.recall_at_k(vectors.topk_vectors(queries, chunks), near, "query_id", "chunk_id")
    return rounded(found.join(read, "query_id"))


@query("topk_index_appended", _topk_sql(False).replace("from e q, e c ", "from e q, e c where q.vec_id % 100 = 0"))
def _(spark, sf_dir):
    """An index of four fifths of the chunks to which all are appended; with every chunk a candidate it answers exactly."""
    queries, chunks = vector_sides(spark, sf_dir)
    path = work_path(spark, "vector-index")
    vector_index.build_index(chunks.where("chunk_id % 5 <> 0"), path, cells=CELLS)
    vector_index.append_index(chunks, path)
    found = vector_index.search_index(queries.where("query_id % 100 = 0"), path, candidates=chunks.count())
    return rounded(found.select("query_id", "chunk_id", "score", "rank"))


def chunk_words_index(spark: SparkSession, sf_dir: str, collections: int = 0) -> str:
    """Path of the word index of the document chunks, built by the first query that asks for it in an application.

    With ``collections`` the chunks fall into that many by document.
    """
    name = hashlib.md5(f"{sf_dir}-{collections}".encode()).hexdigest()
    path = f"{work_dir(spark)}/word-index-{name}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/blocks/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        chunks = doc_chunks(spark, sf_dir)
        if collections:
            chunks = chunks.withColumn("g", F.col("doc_id") % collections)
        word_index.build_words(chunks, path, by=["g"] if collections else None)
    return path


def passages_as_queries(spark: SparkSession, sf_dir: str, key: str, text: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias(key), F.col("text").alias(text))


BM25 = f"""{DOC_CHUNKS}, ct as (select chunk_id, {_tokens_sql('text')} as t from dc),
st as (select count(*) as n, avg(len(t)) as avgdl from ct),
tf as (select chunk_id, len as dl, tok, count(*) as tf from (select chunk_id, len(t) as len, unnest(t) as tok from ct) group by 1, 2, 3),
df as (select tok, count(*) as df from tf group by 1),
q as (select distinct item_id, tok from (select item_id, unnest({_tokens_sql('text')}) as tok from benchmark)),
s as (select q.item_id, tf.chunk_id, round(sum(ln(1.0::double + (n - df.df + 0.5::double) / (df.df + 0.5::double)) *
    (tf.tf * 2.2::double / (tf.tf + 1.2::double * (0.25::double + 0.75::double * tf.dl / avgdl)))), 9) as score
  from q join tf on q.tok = tf.tok join df on df.tok = q.tok, st group by 1, 2),
r as (select *, row_number() over (partition by item_id order by score desc, chunk_id) as rank from s),
top as (select item_id, chunk_id, score, rank from r where rank <= 5)"""


@query("topk_lexical", f"""with {BM25}
select item_id as query_id, chunk_id, {r6("score", "score")}, rank::int as rank from top""")
def _(spark, sf_dir):
    found = word_index.search_words(passages_as_queries(spark, sf_dir, "query_id", "query"), chunk_words_index(spark, sf_dir))
    return rounded(found.select("query_id", "chunk_id", "score", "rank"))


def _by_collection(bm25: str) -> str:
    """The same scores with counts, lengths and frequencies of each query's collection."""
    return bm25.replace("select chunk_id, " + _tokens_sql("text"), "select chunk_id, doc_id % 3 as g, " + _tokens_sql("text")) \
        .replace("st as (select count(*) as n", "st as (select g, count(*) as n").replace("avgdl from ct)", "avgdl from ct group by 1)") \
        .replace("select chunk_id, len as dl, tok, count(*) as tf from (select chunk_id, len(t)", "select chunk_id, g, len as dl, tok, count(*) as tf from (select chunk_id, g, len(t)") \
        .replace("from ct) group by 1, 2, 3)", "from ct) group by 1, 2, 3, 4)").replace("select tok, count(*) as df from tf group by 1", "select g, tok, count(*) as df from tf group by 1, 2") \
        .replace("from q join tf on q.tok = tf.tok join df on df.tok = q.tok, st group by", "from q join tf on q.tok = tf.tok and q.item_id % 3 = tf.g join df on df.tok = q.tok and df.g = tf.g join st on st.g = tf.g group by")


@query("topk_lexical_no_index", f"""with {BM25}
select item_id as query_id, chunk_id, {r6("score", "score")}, rank::int as rank from top""")
def _(spark, sf_dir):
    """The search that goes through the texts themselves, for corpora that are searched once."""
    found = lexical.bm25_topk(passages_as_queries(spark, sf_dir, "query_id", "query"), doc_chunks(spark, sf_dir))
    return rounded(found.select("query_id", "chunk_id", "score", "rank"))


@query("topk_lexical_by_collection", f"""with {_by_collection(BM25)}
select item_id as query_id, chunk_id, {r6("score", "score")}, rank::int as rank from top""")
def _(spark, sf_dir):
    queries = passages_as_queries(spark, sf_dir, "query_id", "query").withColumn("g", F.col("query_id") % 3)
    found = word_index.search_words(queries, chunk_words_index(spark, sf_dir, 3), by=["g"])
    return rounded(found.select("query_id", "chunk_id", "score", "rank"))


@query("retrieve_and_prompt", f"""with {BM25}, ctx as (select item_id, count(*) as n_chunks,
  array_to_string(list(dc.text order by rank), chr(10) || chr(10)) as c from top join dc on top.chunk_id = dc.chunk_id group by 1)
select b.item_id as query_id, coalesce(n_chunks, 0) as n_chunks, case when c is not null then
  md5('system:{PROMPTS[2]["system"]}' || chr(10) || 'user:Context:' || chr(10) || c || chr(10) || chr(10) || b.text || chr(10)) end as digest
from benchmark b left join ctx on b.item_id = ctx.item_id""")
def _(spark, sf_dir):
    queries, chunks = passages_as_queries(spark, sf_dir, "query_id", "query"), doc_chunks(spark, sf_dir)
    found = word_index.search_words(queries, chunk_words_index(spark, sf_dir))
    contexts = context.gather_context(found, chunks)
    asked = context.with_context(queries, contexts).withColumn("pass", F.lit("pass3_strict"))
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    n_chunks = F.coalesce(F.size(F.col("context_chunks")), F.lit(0))
    return prompts.build_messages(asked).select(
        "query_id", F.greatest(n_chunks, F.lit(0)).cast("bigint").alias("n_chunks"), F.md5(flat).alias("digest"))


@query("claim_entailment", f"""with {DOC_CHUNKS}, ct as (select distinct chunk_id, tok from (select chunk_id, unnest({_tokens_sql('text')}) as tok from dc)),
q as (select distinct item_id, tok from (select item_id, unnest({_tokens_sql('text')}) as tok from benchmark)),
m as (select item_id, count(*) as n_claim_tokens from q group by 1),
s as (select item_id, chunk_id, count(*) as n_shared from q join ct on q.tok = ct.tok group by 1, 2)
select s.item_id as claim_id, chunk_id as text_id, n_shared, n_claim_tokens from s join m on s.item_id = m.item_id
where n_shared * 100 >= n_claim_tokens * 70""")
def _(spark, sf_dir):
    return lexical.entailed_claims(passages_as_queries(spark, sf_dir, "claim_id", "claim"), coverage=70, index=chunk_words_index(spark, sf_dir))


@query("claim_alignment")
def _(spark, sf_dir):
    """Of the pairs that share enough tokens those whose tokens match in order; no SQL for the alignment."""
    claims = passages_as_queries(spark, sf_dir, "claim_id", "claim")
    texts = doc_chunks(spark, sf_dir).select(F.col("chunk_id").alias("text_id"), "text")
    pairs = lexical.entailed_claims(claims, coverage=70, index=chunk_words_index(spark, sf_dir))
    return alignment.aligned_claims(pairs, claims, texts, coverage=70)


# --- claim scores: a turn answers the turn before it, its context is what surrounds it -------

COVERAGE = 50


def turn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).where("role = 'assistant'")
    around = F.concat_ws(" ", "before", "text", "after")
    cut = t.withColumn("_around", around).withColumn("_words", words("_around"))
    return cut.select("conv_id", "turn", F.col("text").alias("response"), F.col("before").alias("ground_truth"),
                      chunk_words(F.col("_around"), 30, 10, F.col("_words")).alias("context_chunks"))


def _claims_sql() -> str:
    tok = lambda t: f"list_distinct({_tokens_sql(t)})"
    sent = lambda t: f"list_filter(regexp_split_to_array(coalesce({t}, ''), '{SENTENCE_END}'), lambda s: regexp_matches(s, '[\\p{{L}}\\p{{N}}]'))"
    ent = f"len(list_intersect(c.t, x.t)) * 100 >= len(c.t) * {COVERAGE}"
    share = lambda a, b: f"case when {b} > 0 then {a} / {b}::double else 0.0 end"
    return f"""with {TURNS}, rec as (select conv_id, turn, text as response, before as ground_truth,
  concat_ws(' ', before, text, after) as text from tn where role = 'assistant'),
ck as (select conv_id, turn, i, {tok("chunk")} as t from ({_chunks_sql("rec", "conv_id, turn", 30, 10)})),
r as (select conv_id, turn, i, {tok("s")} as t from (select conv_id, turn, unnest(ss) as s, unnest(range(len(ss))) as i
  from (select conv_id, turn, {sent("response")} as ss from rec))),
g as (select conv_id, turn, i, {tok("s")} as t from (select conv_id, turn, unnest(ss) as s, unnest(range(len(ss))) as i
  from (select conv_id, turn, {sent("ground_truth")} as ss from rec))),
rel as (select x.conv_id, x.turn, x.i, x.t, coalesce(bool_or({ent}), false) as rel from ck x left join g c
  on c.conv_id = x.conv_id and c.turn = x.turn group by all),
rj as (select c.conv_id, c.turn, c.i, any_value(len(list_intersect(c.t, tr.t)) * 100 >= len(c.t) * {COVERAGE}) as ok,
  coalesce(bool_or({ent}), false) as found, coalesce(bool_or(x.rel and {ent}), false) as inrel
  from r c join (select conv_id, turn, {tok("coalesce(ground_truth, '')")} as t from rec) tr on tr.conv_id = c.conv_id and tr.turn = c.turn
  left join rel x on x.conv_id = c.conv_id and x.turn = c.turn group by 1, 2, 3),
gj as (select c.conv_id, c.turn, c.i, any_value(len(list_intersect(c.t, tr.t)) * 100 >= len(c.t) * {COVERAGE}) as ok,
  coalesce(bool_or({ent}), false) as found
  from g c join (select conv_id, turn, {tok("response")} as t from rec) tr on tr.conv_id = c.conv_id and tr.turn = c.turn
  left join rel x on x.conv_id = c.conv_id and x.turn = c.turn group by 1, 2, 3),
ra as (select conv_id, turn, count(*) as n, count_if(ok) as ok, count_if(found) as found, count_if(ok and not found) as self,
  count_if(not ok and not found) as hal, count_if(not ok and inrel) as nr, count_if(not ok and found and not inrel) as ni from rj group by 1, 2),
ga as (select conv_id, turn, count(*) as n, count_if(ok) as ok, count_if(found) as found, count_if(ok and found) as used from gj group by 1, 2),
ca as (select conv_id, turn, count(*) as n, count_if(rel) as rel from rel group by 1, 2),
m as (select rec.conv_id, rec.turn, {share("ra.ok", "ra.n")} as p, {share("ga.ok", "ga.n")} as rc, {share("ga.found", "ga.n")} as claim_recall,
  {share("ca.rel", "ca.n")} as context_precision, {share("ga.used", "ga.found")} as context_utilization, {share("ra.self", "ra.n")} as self_knowledge,
  {share("ra.nr", "ra.n")} as noise_sensitivity_relevant, {share("ra.ni", "ra.n")} as noise_sensitivity_irrelevant,
  {share("ra.hal", "ra.n")} as hallucination, {share("ra.found", "ra.n")} as faithfulness
  from rec left join ra on ra.conv_id = rec.conv_id and ra.turn = rec.turn left join ga on ga.conv_id = rec.conv_id and ga.turn = rec.turn
  left join ca on ca.conv_id = rec.conv_id and ca.turn = rec.turn),
o as (select *, p as overall_precision, rc as overall_recall, case when p + rc > 0 then 2 * p * rc / (p + rc) else 0.0 end as overall_f1 from m)
select conv_id, turn, {", ".join(r6(f, f) for f in SCORE_FIELDS)} from o"""


@query("claim_metrics", _claims_sql())
def _(spark, sf_dir):
    return rounded(claims.claim_metrics(turn_records(spark, sf_dir), ["conv_id", "turn"], coverage=COVERAGE))

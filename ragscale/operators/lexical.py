"""Token-overlap joins between short texts and many long ones.

Both operators find candidates through the rare tokens that a match cannot do
without, and verify candidates in full. Frequent tokens never drive a join, and
results are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window, functions as F

from ragscale.functions.text import exploded, tokens
from ragscale.operators.skew import hot_keys, is_small, join_same, replicated, small, with_salt
from ragscale.operators.word_index import B, DIGITS, K1, open_words, postings_of
from ragscale.schemas import TOP_K
from ragscale.session import materialize

POSTING_BLOCK = 1 << 20


def _vocabulary(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return exploded(df, keys, F.array_distinct(tokens(text)), "token")


def _postings(df: DataFrame, keys: list[str], vocabulary: DataFrame, by: list[str]) -> DataFrame:
    """``(keys, token, tf, n_tokens)`` for the tokens of a vocabulary; ``df`` has the tokens as ``_t``."""
    rows = exploded(df.withColumn("n_tokens", F.size("_t")), [*keys, "n_tokens"], F.col("_t"), "token")
    known = join_same(rows, vocabulary.select(*by, "token").distinct(), [*by, "token"], "left_semi")
    return known.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"), F.first("n_tokens").alias("n_tokens"))


def _token_hits(terms: DataFrame, postings: DataFrame, by_text: str, by: list[str]) -> DataFrame:
    """Inverted-index join on the token (inside a collection); a frequent token is split over several tasks."""
    keys = [*by, "token"]
    used = join_same(postings, small(terms.select(*keys).distinct()), keys, "left_semi")
    hot = hot_keys(used, keys, POSTING_BLOCK)
    big, few = with_salt(used, keys, hot, by_text), replicated(terms, keys, hot)
    return join_same(few, big, [*keys, "_salt"]).drop("_salt")


def _pair_hits(pairs: DataFrame, terms: DataFrame, postings: DataFrame, left: str, right: str) -> DataFrame:
    """The given terms of every given pair that its text holds. Postings of texts in no pair drop out first."""
    used = postings.join(small(pairs.select(right).distinct()), right, "left_semi")
    return pairs.join(terms, left).join(used, [right, "token"])


def bm25_topk(
    queries: DataFrame, chunks: DataFrame, k: int = TOP_K, query_id: str = "query_id", chunk_id: str = "chunk_id",
    query_text: str = "query", chunk_text: str = "text", seed_rows: int = 2000,
    rest_share: float = 0.5, by: list[str] | None = None,
) -> DataFrame:
    """The k chunks with the highest BM25 score per query: ``(query, chunk, score, rank)``.

    With ``by`` a query meets only chunks of its own collection, whose chunk count, mean length and token
    frequencies alone weigh; chunk ids are unique through all collections.

    A first round over each query's rarest tokens finds a score that its k-th
    chunk reaches. Frequent tokens whose best scores together stay below it cannot
    lift a chunk into the result alone, so only the other tokens drive the second
    round, and only chunks still able to reach the score are completed with the
    frequent ones. The result is exact for any ``seed_rows`` and ``rest_share`` (at
    most 1): they set how much the first round reads and how many tokens may rest.
    """
    by = by or []
    cut = chunks.select(*by, chunk_id, tokens(chunk_text).alias("_t"))
    vocabulary = _vocabulary(queries, [*by, query_id], query_text)
    measures = [F.count(F.lit(1)).alias("_n"), F.avg(F.size("_t")).alias("_len")]
    seen = Observation()
    if not by:
        cut = cut.observe(seen, *measures)  # counted while the postings are written
    counted = materialize(_postings(cut, [*by, chunk_id], vocabulary, by), "postings")
    if by:
        sizes = materialize(cut.groupBy(*by).agg(*measures), "sizes")
        sizes = F.broadcast(sizes) if is_small(sizes) else sizes

    def with_sizes(df: DataFrame) -> DataFrame:
        if by:
            return join_same(df, sizes, by)
        return df.withColumns({"_n": F.lit(float(seen.get["_n"] or 0)), "_len": F.lit(float(seen.get["_len"] or 1.0))})

    norm = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("n_tokens") / F.col("_len"))
    weight = F.col("tf") * F.lit(K1 + 1.0) / (F.col("tf") + norm)
    postings = with_sizes(counted).select(*by, chunk_id, "token", weight.alias("weight"))
    stats = with_sizes(postings.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("_max")))
    idf = F.log(F.lit(1.0) + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = join_same(vocabulary, stats, [*by, "token"]).select(*by, query_id, "token", "df", idf.alias("idf"), (idf * F.col("_max")).alias("_bound"))
    rare = Window.partitionBy(query_id).orderBy("df", "token")
    to_here = F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, 0))
    ranked = terms.withColumn("_r", F.row_number().over(rare)).withColumn("_rows", to_here)
    terms = materialize(ranked, "terms")
    pair = [query_id, chunk_id]
    gain = F.sum(F.col("idf") * F.col("weight"))
    weights = terms.select(query_id, "token", "idf")
    plain = postings.select(chunk_id, "token", "weight")

    def top(found: DataFrame, n: int) -> DataFrame:
        best = Window.partitionBy(query_id).orderBy(F.desc("score"), chunk_id)
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)

    seeded = terms.where((F.col("_r") == 1) | (F.col("_rows") <= seed_rows)).select(*by, query_id, "token", "idf")
    promising = top(_token_hits(seeded, postings, chunk_id, by).groupBy(*pair).agg(gain.alias("score")), 4 * k)
    promising = materialize(promising.select(*pair), "promising")  # read twice below
    known = _pair_hits(promising, weights, plain, query_id, chunk_id).groupBy(*pair).agg(gain.alias("score"))
    reached = top(known, k).where(F.col("rank") == k).select(query_id, F.col("score").alias("_reached"))

    together = F.sum("_bound").over(Window.partitionBy(query_id).orderBy(F.desc("_r")))
    bounded = terms.withColumn("_together", together).join(reached, query_id, "left")
    bounded = materialize(bounded.withColumn("_reached", F.coalesce("_reached", F.lit(0.0)) - 1e-6), "bounds")
    rests = F.col("_together") < F.col("_reached") * rest_share
    driving = bounded.where(~rests).select(*by, query_id, "token", "idf")
    resting = bounded.where(rests)
    limits = bounded.groupBy(query_id).agg(
        F.first("_reached").alias("_reached"), F.sum(F.when(rests, F.col("_bound")).otherwise(0.0)).alias("_rest"))
    part = _token_hits(driving, postings, chunk_id, by).groupBy(*pair).agg(gain.alias("_part"))
    alive = part.join(limits, query_id).where("_part + _rest >= _reached").select(*pair, "_part")
    alive = materialize(alive, "alive")  # read three times below
    more = _pair_hits(alive, resting.select(query_id, "token", "idf"), plain, query_id, chunk_id).select(
        *pair, (F.col("idf") * F.col("weight")).alias("_part"))
    total = F.round(F.sum("_part"), DIGITS).alias("score")
    return top(alive.unionByName(more).groupBy(*pair).agg(total), k)


def entailed_claims(
    claims: DataFrame, texts: DataFrame | None = None, coverage: int = 80, claim_id: str = "claim_id", text_id: str = "text_id",
    claim: str = "claim", text: str = "text", index: str | None = None,
) -> DataFrame:
    """Texts holding at least ``coverage`` percent of a claim's distinct tokens.

    A match that may lack d of a claim's tokens holds one of any d + 1 of them,
    so the d + 1 rarest tokens find all candidates. With ``index`` (a path of ``word_index``) the stored
    postings stand for the texts, which are not read.
    """
    vocabulary = _vocabulary(claims, [claim_id], claim)
    if index is not None:
        found = postings_of(open_words(claims.sparkSession, index), vocabulary, text_id)
    else:
        cut = texts.select(text_id, F.array_distinct(tokens(text)).alias("_t"))
        found = _postings(cut, [text_id], vocabulary, [])
    postings = materialize(found.select(text_id, "token"), "postings")
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy(claim_id).orderBy(F.coalesce("df", F.lit(0)), "token")
    sizes = vocabulary.groupBy(claim_id).agg(F.count(F.lit(1)).alias("n_claim_tokens"))
    need = F.ceil(F.col("n_claim_tokens") * coverage / F.lit(100)).cast("bigint")
    ranked = vocabulary.join(df, "token", "left").withColumn("_r", F.row_number().over(rare)).join(sizes, claim_id)
    drivers = ranked.where(F.col("df").isNotNull() & (F.col("_r") <= F.col("n_claim_tokens") - need + 1))
    drivers = materialize(drivers.select(claim_id, "token"), "drivers")  # counted and read
    pairs = materialize(_token_hits(drivers, postings, text_id, []).select(claim_id, text_id).distinct(), "pairs")
    shared = _pair_hits(pairs, vocabulary, postings, claim_id, text_id).groupBy(claim_id, text_id).agg(
        F.count(F.lit(1)).alias("n_shared"))
    return shared.join(sizes, claim_id).where(F.col("n_shared") * 100 >= F.col("n_claim_tokens") * coverage)

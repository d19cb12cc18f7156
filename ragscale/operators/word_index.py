"""A stored word index: block-max postings that searches open by their path.

``build_words`` splits every text once. Consecutive chunks of a task form ranges of ``RANGE`` chunks; the postings of a
token in a range are one row, with the highest frequency and the shortest text in it, which bound every score there. Files
are sorted by token. A search reads the rows of its queries' tokens: sums of bounds tell which ranges can hold one of a
query's k best chunks, and only their postings are scored. Texts are not read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ragscale.functions.text import exploded, tokens
from ragscale.operators.skew import hot_keys, is_small, join_same, replicated, with_salt
from ragscale.schemas import TOP_K
from ragscale.session import materialize

K1, B = 1.2, 0.75
DIGITS = 9
RANGE = 32  # chunks of a range
SEGMENT = 32  # ranges scored together
SEEDS = 4  # ranges of the highest bounds that a query scores first
TERMS = 1 << 20  # query terms that meet a segment in one task; more are dealt over several
POSTING_BLOCK = 1 << 18
LISTED = 5000  # tokens that are pushed down to the file scan as a list


def _block_schema(chunks: DataFrame, by: list[str], chunk_id: str) -> T.StructType:
    """One row for each token of a range (null: all chunks of the range, ``total`` being their tokens)."""
    ints = T.ArrayType(T.IntegerType())
    return T.StructType([
        *[chunks.schema[b] for b in by], T.StructField("token", T.StringType()), T.StructField("range", T.LongType()),
        T.StructField("n", T.IntegerType()), T.StructField("max_tf", T.IntegerType()), T.StructField("min_len", T.IntegerType()),
        T.StructField("total", T.LongType()), T.StructField("chunks", T.ArrayType(chunks.schema[chunk_id].dataType)),
        T.StructField("tfs", ints), T.StructField("lens", ints),
    ])


def _blocks(chunks: DataFrame, by: list[str], chunk_id: str, text: str, first_range: int) -> DataFrame:
    schema = _block_schema(chunks, by, chunk_id)
    cut = chunks.select(*by, chunk_id, F.coalesce(tokens(text), F.array().cast("array<string>")).alias("_t"))
    n_by = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = first_range + (TaskContext.get().partitionId() << 33)
        for whole in batches:
            for k in range(0, whole.num_rows, 64 * RANGE):
                batch = whole.slice(k, 64 * RANGE)
                n, ids, lists = batch.num_rows, batch.column(n_by), batch.column(n_by + 1)
                lens = np.diff(lists.offsets.to_numpy())
                collection = np.zeros(n, np.int64)
                for c in range(n_by):
                    code = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
                    collection = np.unique(collection * (code.max() + 1) + code, return_inverse=True)[1]
                # A range holds chunks of one collection: a collection's chunks are counted among themselves.
                order = np.argsort(collection, kind="stable")
                place = np.empty(n, np.int64)
                place[order] = np.arange(n) - np.searchsorted(collection[order], collection[order])
                _, span = np.unique(np.stack([collection, place // RANGE]), axis=1, return_inverse=True)
                span = span.ravel()
                words = lists.flatten().dictionary_encode()
                row = np.repeat(np.arange(n), lens)
                code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                width = len(words.dictionary) + 1
                # Code 0 stands for the whole range.
                key = np.concatenate([span * width, span[row] * width + code + 1])
                row = np.concatenate([np.arange(n), row])
                pair, tf = np.unique(key * n + row, return_counts=True)
                key, row = pair // n, pair % n
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                offsets = np.append(starts, len(key))
                of, token = key[starts] // width, key[starts] % width
                length = lens[row]
                yield pa.record_batch([
                    *[batch.column(c).take(pa.array(row[starts])) for c in range(n_by)],
                    words.dictionary.take(pa.array(np.maximum(token - 1, 0), mask=token == 0)) if width > 1 else pa.nulls(len(token), pa.string()),
                    pa.array(at + of), pa.array(np.diff(offsets).astype(np.int32)),
                    pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)), pa.array(np.minimum.reduceat(length, starts).astype(np.int32)),
                    pa.array(np.add.reduceat(length, starts).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ids.take(pa.array(row))),
                    *[pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v.astype(np.int32))) for v in (tf, length)],
                ], names=schema.names)
                at += int(span.max()) + 1

    return cut.mapInArrow(run, schema).sortWithinPartitions("token", "range")


def build_words(chunks: DataFrame, path: str, by: list[str] | None = None, chunk_id: str = "chunk_id", text: str = "text") -> None:
    """Write the index of all chunks to ``path``, over whatever is there. A null text has no tokens; ids are unique (within ``by``)."""
    _blocks(chunks, by or [], chunk_id, text, 0).write.mode("overwrite").parquet(f"{path}/blocks")


def append_words(chunks: DataFrame, path: str, by: list[str] | None = None, chunk_id: str = "chunk_id", text: str = "text") -> None:
    """Add the chunks whose ids the index doesn't have yet. Stored files stay; only new texts are split."""
    by = by or []
    stored = chunks.sparkSession.read.parquet(f"{path}/blocks")
    known = stored.where("token is null").select(*by, F.explode("chunks").alias(chunk_id))
    new = join_same(chunks, known, [*by, chunk_id], "left_anti")
    last = stored.agg(F.max("range")).first()[0]
    # Ranges of a build begin at a multiple of 2**33 for each task; the next build's begin behind them all.
    _blocks(new, by, chunk_id, text, 0 if last is None else ((last >> 33) + 1) << 33).write.mode("append").parquet(f"{path}/blocks")


def open_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/blocks")


def _of_vocabulary(blocks: DataFrame, vocabulary: DataFrame, by: list[str]) -> DataFrame:
    """The rows of a vocabulary's tokens."""
    known = vocabulary.select(*by, "token").distinct()
    if not by and is_small(known, LISTED):
        return blocks.where(F.col("token").isin([r["token"] for r in known.collect()]))
    return join_same(blocks.where("token is not null"), F.broadcast(known) if is_small(known) else known, [*by, "token"], "left_semi")


def postings_of(blocks: DataFrame, vocabulary: DataFrame, text_id: str, by: list[str] | None = None) -> DataFrame:
    """``by, text_id, token`` of every chunk that holds a token of the vocabulary."""
    return _of_vocabulary(blocks, vocabulary, by or []).select(*(by or []), "token", F.explode("chunks").alias(text_id))


def _weight(tf: Column, length: Column, mean: Column) -> Column:
    return tf * F.lit(K1 + 1.0) / (tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * length / mean))


def search_words(
    queries: DataFrame, path: str, k: int = TOP_K, by: list[str] | None = None, query_id: str = "query_id",
    chunk_id: str = "chunk_id", query_text: str = "query", seeds: int = SEEDS,
) -> DataFrame:
    """The k chunks with the highest BM25 score per query: ``(query, chunk, score, rank)``, equal scores by smaller chunk id.

    With ``by`` a query meets only chunks of its own collection, whose chunk count, mean length and token frequencies
    alone weigh. Exact for any ``seeds``, which sets how many ranges a query scores before bounds are compared.
    """
    by = by or []
    blocks = open_words(queries.sparkSession, path)
    sizes = blocks.where("token is null").groupBy(*by).agg(F.sum("n").alias("_n"), (F.sum("total") / F.sum("n")).alias("_mean"))
    sizes = materialize(sizes, "sizes")
    vocabulary = materialize(exploded(queries, [*by, query_id], F.array_distinct(tokens(query_text)), "token"), "vocabulary")
    held = materialize(_of_vocabulary(blocks, vocabulary, by).drop("total"), "blocks-asked")
    df = held.groupBy(*by, "token").agg(F.sum("n").alias("_df"))

    def with_sizes(rows: DataFrame) -> DataFrame:
        if by:
            return join_same(rows, F.broadcast(sizes) if is_small(sizes) else sizes, by)
        return rows.crossJoin(F.broadcast(sizes))  # one row

    mean_safe = F.greatest(F.col("_mean"), F.lit(1e-9))
    idf = F.log(F.lit(1.0) + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    terms = join_same(vocabulary, with_sizes(df), [*by, "token"]).select(*by, query_id, "token", idf.alias("idf"), mean_safe.alias("mean"))
    terms = materialize(terms, "terms")
    keys = [*by, "token"]
    light = held.select(*keys, "range", "max_tf", "min_len")
    if is_small(terms):
        # All tokens of a range meet in one task, so that a sum of bounds is whole there and only sums are many.
        met = join_same(light.repartition("range"), F.broadcast(terms), keys)
    else:
        hot = hot_keys(light, keys, POSTING_BLOCK)
        met = join_same(replicated(terms, keys, hot), with_salt(light, keys, hot, "range"), [*keys, "_salt"])
    bound = F.sum(F.col("idf") * _weight(F.col("max_tf"), F.col("min_len"), F.col("mean")))
    bounds = materialize(met.groupBy(query_id, "range").agg(bound.alias("_bound")), "bounds")

    best = Window.partitionBy(query_id).orderBy(F.desc("_bound"), "range")
    chosen = bounds.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= seeds).select(query_id, "range")
    chosen = materialize(chosen, "seeds")
    first = materialize(_scored(chosen, terms, held, query_id, chunk_id, k), "first")
    reached = _top(first, query_id, chunk_id, k).where(F.col("rank") == k).select(query_id, F.col("score").alias("_reached"))
    # A chunk of another range can only count if the range's bound reaches the k-th score found.
    able = bounds.join(reached, query_id, "left").where(F.col("_bound") >= F.coalesce("_reached", F.lit(0.0)) - 1e-6)
    rest = materialize(able.select(query_id, "range").join(chosen, [query_id, "range"], "left_anti"), "able")
    return _top(first.unionByName(_scored(rest, terms, held, query_id, chunk_id, k)), query_id, chunk_id, k)


def _top(found: DataFrame, query_id: str, chunk_id: str, k: int) -> DataFrame:
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), chunk_id)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _scored(pairs: DataFrame, terms: DataFrame, blocks: DataFrame, query_id: str, chunk_id: str, k: int) -> DataFrame:
    """Each query's k best chunks of each segment, scored over the given pairs of query and range.

    A task meets one segment's postings and a bounded share of the terms asked there; products are made in slices.
    """
    n_terms = terms.count()
    shares = max(1, -(-n_terms // TERMS))
    share = F.pmod(F.xxhash64(query_id), F.lit(shares)).cast("int")
    segment = F.floor(F.col("range") / SEGMENT).cast("bigint")
    # A query's terms go once to a segment, with its ranges there; tasks put them together.
    spans = pairs.groupBy(query_id, segment.alias("_segment")).agg(F.collect_list("range").alias("_ranges"))  # ``SEGMENT`` at most
    asked = spans.join(terms.select(query_id, "token", "idf", "mean"), query_id)
    left = asked.select("_segment", share.alias("_share"), query_id, "_ranges", "token", "idf", "mean")
    used = blocks.join(pairs.select("range").distinct(), "range", "left_semi")
    right = used.select(segment.alias("_at"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_part"), "range", "token", "chunks", "tfs", "lens")
    id_type = blocks.schema["chunks"].dataType.elementType
    schema = T.StructType([terms.schema[query_id], T.StructField(chunk_id, id_type), T.StructField("score", T.DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ranges = a.column("_ranges").combine_chunks()
        line = pa.array(np.repeat(np.arange(a.num_rows), np.diff(ranges.offsets.to_numpy())))
        a = a.select([query_id, "token", "idf", "mean"]).take(line).append_column("range", ranges.flatten())
        q_ids = a.column(query_id).combine_chunks()
        lists = b.column("chunks").combine_chunks() if b.num_rows else None
        if not a.num_rows or lists is None:
            empty = pa.array([], type=q_ids.type) if a.num_rows == 0 else q_ids.slice(0, 0)
            none = b.column("chunks").type.value_type
            return pa.table([empty, pa.array([], type=none), pa.array([], pa.float64())], names=schema.names)
        names = b.column("token").combine_chunks().dictionary_encode()
        token = pc.index_in(a.column("token").combine_chunks(), names.dictionary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        low = min(pc.min(a.column("range")).as_py(), pc.min(b.column("range")).as_py())
        width = len(names.dictionary) + 1
        have = (b.column("range").to_numpy() - low) * width + names.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(have, kind="stable")
        want = (a.column("range").to_numpy() - low) * width + token
        spot = np.minimum(np.searchsorted(have[order], want), len(have) - 1)
        block = order[spot]
        hit = np.flatnonzero((token >= 0) & (have[block] == want))
        offsets = lists.offsets.to_numpy()
        chunk = lists.flatten().dictionary_encode()
        chunk_codes = chunk.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        tfs, lens = (b.column(c).combine_chunks().flatten().to_numpy().astype(np.float64) for c in ("tfs", "lens"))
        q_codes = q_ids.dictionary_encode()
        q = q_codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        hit = hit[np.argsort(q[hit], kind="stable")]
        sizes = (offsets[1:] - offsets[:-1])[block[hit]]
        idf, mean = a.column("idf").to_numpy(), a.column("mean").to_numpy()
        n_chunks = len(chunk.dictionary)
        rank = np.argsort(np.argsort(np.array(chunk.dictionary.to_pylist()), kind="stable"), kind="stable")
        out_q, out_c, out_s = [], [], []
        done = 0
        ends = np.flatnonzero(np.concatenate([q[hit][1:] != q[hit][:-1], [True]])) + 1 if len(hit) else np.zeros(0, np.int64)
        total = np.cumsum(sizes)
        while done < len(hit):
            # Whole queries, some four million products at a time.
            to = ends[min(max(np.searchsorted(total[ends - 1], (total[done - 1] if done else 0) + (1 << 22), "right") - 1, np.searchsorted(ends, done, "right")), len(ends) - 1)]
            some, n = hit[done:to], sizes[done:to]
            item = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1][block[some]] - offsets[0], n)
            line = np.repeat(some, n)
            tf = tfs[item]
            weight = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * lens[item] / mean[line]))
            pair, inverse = np.unique(q[line] * n_chunks + chunk_codes[item], return_inverse=True)
            score = np.round(np.bincount(inverse.ravel(), weights=idf[line] * weight), DIGITS)
            pq, pcode = pair // n_chunks, pair % n_chunks
            best = np.lexsort((rank[pcode], -score, pq))
            pq = pq[best]
            first = np.flatnonzero(np.concatenate([[True], pq[1:] != pq[:-1]]))
            keep = np.arange(len(pq)) - np.repeat(first, np.diff(np.append(first, len(pq)))) < k
            out_q.append(pq[keep])
            out_c.append(pcode[best][keep])
            out_s.append(score[best][keep])
            done = to
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        columns = [q_codes.dictionary.take(pa.array(cat(out_q, np.int64))), chunk.dictionary.take(pa.array(cat(out_c, np.int64))), pa.array(cat(out_s, np.float64))]
        return pa.table(columns, names=schema.names)

    return left.groupBy("_segment", "_share").cogroup(right.groupBy("_at", "_part")).applyInArrow(run, schema)

"""Near-duplicate groups by exact Jaccard similarity of word shingles, proposed by SimHash.

SimHash fingerprints of the shingles propose pairs within a few bits; every proposal is verified on the whole sets. What
they miss, prefixes of the sets find: two sets whose similarity reaches ``least`` share an element among the first
``n - ceil(least * n) + 1`` of either, in any order of elements that is common to all sets. Elements known to be frequent
come last in the order. All sets of an element are first compared with one of them; then only pairs that no chain of links
joins yet are compared, so no such pair is missed, and groups of copies cost as many comparisons as they have members.
A pair left over is only compared if it shares so many elements of its prefixes that the rests can bring it to ``least``. Of
crowded elements whose members would meet very often, those take part that share enough with the others at all: what only one of
these sets has is in no two of them.
Sets move in passes, so that the disk holds a part of the pairs' sets at a time, and all pairs have had their pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ragscale.llm.arrays import give_back, let_go, text_buffers, text_slices, word_bounds
from ragscale.llm.components import connected_components
from ragscale.llm.frames import carry, with_names
from ragscale.llm.simhash import _LOWER, PAIRED, first_of_groups, majority_bits, near_links
from ragscale.operators.skew import with_dimension
from ragscale.session import discard, materialize

SHINGLE, LEAST = 5, 0.8
DISTANCE = 2  # bits within which SimHash proposes pairs
SLICE = 1 << 18  # bytes of text whose shingles are made at once
FREQUENT = 10_000  # elements that are put last at most; which ones changes the work, not the result
PIVOTS = 4  # rounds in which the members of a crowded value are compared with one of them
FEW = 0.001  # links for each set, below which another such round costs more than it saves
BLOCK = 2 << 20  # bytes of a row group of written sets, which are read many times
BYTES = 6  # of an element's hash
REPEATED = 1.1  # sets that may be there for each different one
NARROW_ROWS = 1_000_000  # rows of a few numbers each that are broadcast at most
MOVED = 0.25  # pairs whose sets move in one pass, for each set there is

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's shingles, repeats included, and where each row's begin. A text under ``shingle`` words has one."""
    from xxhash import xxh64_intdigest

    starts, ends, first = word_bounds(data, offsets)
    text = _LOWER[data].tobytes()
    word = np.fromiter((xxh64_intdigest(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    words = np.diff(first)
    per = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(per)])
    left = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], per)
    used = np.repeat(np.minimum(words, shingle), per)
    h = used.astype(np.uint64)
    for step in range(shingle):
        more = used > step
        h[more] = _mixed(h[more] * _A + word[left[more] + step])
    return h, at


def distinct_elements(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, cut to ``BYTES`` bytes, ascending, and where each row's begin."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    h = h >> np.uint64(64 - 8 * BYTES)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(at)))


def packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Elements of rows as binary, ``BYTES`` bytes each."""
    flat = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at * BYTES, np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all rows (int64), and where each row's begin."""
    flat, offsets = text_buffers(column)
    wide = np.zeros((len(flat) // BYTES, 8), np.uint8)
    wide[:, 8 - BYTES :] = flat.reshape(-1, BYTES)
    return wide.view(">i8").ravel().astype(np.int64), offsets // BYTES


def written_sets(docs: DataFrame, keep: list[str], text: str, shingle: int) -> DataFrame:
    """Written ``k0, k1, ..., row, fp, sim, n, elements``: a number of the row, a digest of its set, its SimHash fingerprint,
    the set's size and the set, which is null where the task has written the same set before."""
    rows, _ = carry(docs, keep, F.col(text).cast("string"))
    names = [f"k{i}" for i in range(len(keep))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        done, seen = TaskContext.get().partitionId() << 33, set()
        for part in text_slices(batches, "x0", SLICE):
            hashes, row_at = shingle_hashes(*text_buffers(part.column(len(keep))), shingle)
            sim = majority_bits(hashes, row_at)
            values, at = distinct_elements(hashes, row_at)
            total = np.concatenate([[0], np.cumsum(_mixed(values * _A))]).astype(np.uint64)  # sums wrap, order does not matter
            n = np.diff(at)
            fp = _mixed(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64) * _B).view(np.int64)
            new = np.fromiter((not (x in seen or seen.add(x)) for x in fp.tolist()), bool, len(fp))
            elements = pc.if_else(pa.array(new), packed(values, at), pa.scalar(None, pa.binary()))
            yield pa.record_batch(
                [*part.columns[: len(keep)], pa.array(done + np.arange(len(n))), pa.array(fp), pa.array(sim.view(np.int64)), pa.array(n.astype(np.int32)), elements],
                names=[*names, "row", "fp", "sim", "n", "elements"],
            )
            done += len(n)

    fields = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    return materialize(rows.mapInArrow(task, f"{fields}row bigint, fp bigint, sim bigint, n int, elements binary"), "sets", BLOCK)


def prefixes(sets: DataFrame, least: float, last: np.ndarray) -> DataFrame:
    """``element, fp, n``: the prefix of each set in the order of hashes, but those in ``last`` after all others and in its order."""
    by_value = np.argsort(last, kind="stable")
    held = sets.sparkSession.sparkContext.broadcast((last[by_value], by_value + 1))  # FREQUENT elements at most

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, place = held.value
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                n = part.column(1).to_numpy().astype(np.int64)
                values, _ = unpacked(part.column(2))
                row = np.repeat(np.arange(len(n)), n)
                if len(late):
                    there = np.minimum(np.searchsorted(late, values), len(late) - 1)
                    order = np.lexsort((values, np.where(late[there] == values, place[there], 0), row))
                    values = values[order]
                size = np.where(n > 0, n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, 0)
                keep = np.arange(len(values)) - (np.cumsum(n) - n)[row] < size[row]
                row = row[keep]
                yield pa.record_batch([pa.array(values[keep]), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], names=["element", "fp", "n"])
            give_back()

    return sets.select("fp", "n", "elements").mapInArrow(task, "element bigint, fp bigint, n int")


def shared_counts(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``fp, held``: how many elements of each set of ``members`` (column ``fp``, distinct) another one of them has too. Written."""
    own = with_dimension(sets.select("fp", "elements"), members, ["fp"], "left_semi", NARROW_ROWS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices([batch], "elements", SLICE):
                values, at = unpacked(part.column(1))
                yield pa.record_batch([pa.array(values), part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(at))))], names=["element", "fp"])

    each = materialize(own.mapInArrow(task, "element bigint, fp bigint"), "members")
    several = each.groupBy("element").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("element")
    told = members.join(each.join(several, "element").groupBy("fp").agg(F.count(F.lit(1)).alias("held")), "fp", "left")
    told = materialize(told.select("fp", F.coalesce("held", F.lit(0)).alias("held")), "held")
    discard(each)
    return told


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The distinct pairs ``a, b`` of set digests whose sets have a similarity of ``least`` or more. Written.

    The set of ``b`` moves once for each pair, that of ``a`` once for all its pairs. A pass takes the pairs of some ``a``, some
    MOVED times as many as there are sets; its shuffle files go before the next one.
    """
    pairs = materialize(pairs.distinct(), "pairs")
    passes = max(1, math.ceil(pairs.count() / max(1.0, MOVED * sets.count())))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = np.zeros(batch.num_rows, bool)
            for k in range(0, batch.num_rows, 64):
                (x, at), (y, to) = (unpacked(batch.column(c).slice(k, 64)) for c in (2, 3))
                for i in range(len(at) - 1):
                    a, b = x[at[i] : at[i + 1]], y[to[i] : to[i + 1]]
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    close[k + i] = common >= least * (len(a) + len(b) - common) - 1e-9
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(close))
            give_back()

    links = []
    for number in range(passes):
        some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(passes)) == number) if passes > 1 else pairs
        own = with_dimension(sets.select(F.col("fp").alias("b"), F.col("elements").alias("y")), some, ["b"], "inner", NARROW_ROWS)
        pivots = with_dimension(sets.select(F.col("fp").alias("a"), F.col("elements").alias("x")), some.select("a").distinct(), ["a"], "left_semi", NARROW_ROWS)
        links.append(materialize(own.join(pivots, "a").select("a", "b", "x", "y").mapInArrow(task, "a bigint, b bigint"), "verified"))
    discard(pairs)
    return reduce(DataFrame.unionByName, links)


def simhash_pairs(sets: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a, b`` of set digests whose SimHash fingerprints are equal or linked within ``distance`` bits."""
    firsts = materialize(sets.groupBy("sim").agg(F.min("fp").alias("a")), "simhash")
    same = with_dimension(sets.select("sim", F.col("fp").alias("b")), firsts, ["sim"], "inner", NARROW_ROWS).where("a != b").select("a", "b")
    links = near_links(firsts.select(F.col("sim").alias("fp")), distance).select(F.col("a").alias("one"), F.col("b").alias("two"))
    ends = links.join(firsts.select(F.col("sim").alias("one"), "a"), "one").join(firsts.select(F.col("sim").alias("two"), F.col("a").alias("b")), "two")
    return same.unionByName(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def similar_links(sets: DataFrame, least: float, paired: int = PAIRED, distance: int = DISTANCE) -> DataFrame:
    """``node, root``: components of the distinct sets over all pairs with a similarity of ``least`` or more."""
    fits = lambda a, b: F.least(a, b) >= F.lit(least) * F.greatest(a, b) - F.lit(1e-9)
    links = verified(simhash_pairs(sets, distance), sets, least)

    known = prefixes(sets, least, np.zeros(0, np.int64)).groupBy("element").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > paired)
    often = materialize(known.orderBy(F.desc("n"), "element").limit(FREQUENT), "frequent").collect()  # FREQUENT rows at most
    last = [r["element"] for r in sorted(often, key=lambda r: (r["n"], r["element"]))]
    found = materialize(prefixes(sets, least, np.array(last, np.int64)), "prefixes")
    sizes = found.groupBy("element").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(found.join(sizes, "element"), "shared")
    discard(found)

    def open_members() -> tuple[DataFrame, DataFrame]:
        """Components so far, and the members of elements whose sets aren't one of them already."""
        roots = connected_components(links)
        placed = shared.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        several = placed.groupBy("element").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("element")
        return roots, materialize(placed.join(several, "element", "left_semi"), "open")

    roots, left = open_members()
    worth = sets.count() * FEW
    for number in range(PIVOTS):
        # Each member against one of them: all members at first, then those of crowded values while that finds links.
        some = left if number == 0 else left.where(F.col("size") > paired)
        if some.limit(1).count() == 0:
            break
        chosen = some.groupBy("element").agg(F.min(F.struct(F.xxhash64("fp", F.lit(number)).alias("h"), "fp", "n", "root")).alias("p"))
        met = some.join(chosen, "element").where((F.col("root") != F.col("p.root")) & fits(F.col("n"), F.col("p.n")))
        more = verified(met.select(F.col("p.fp").alias("a"), F.col("fp").alias("b")), sets, least)
        new = more.count()
        if not new:
            break
        links = links.unionByName(more)
        if number and new < worth:
            break  # what is left is compared below
        discard(left)
        roots, left = open_members()
    if left.limit(1).count() == 0:
        return roots
    # All pairs of different components that meet, with the number of elements they share.
    small = left.where(F.col("size") <= paired)
    gathered = small.groupBy("element").agg(F.collect_list(F.struct("fp", "n", "root")).alias("all"))  # at most ``paired`` of them
    other = F.filter("all", lambda o: (o["fp"] > F.col("one.fp")) & (o["root"] != F.col("one.root")) & fits(o["n"], F.col("one.n")))
    near = gathered.select(F.explode("all").alias("one"), "all").select("one", F.explode(other).alias("two"))
    near = near.select(F.col("one.fp").alias("a"), F.col("one.n").alias("na"), F.col("two.fp").alias("b"), F.col("two.n").alias("nb"))
    # Of a crowded value the members outside its largest component meet all others, so that no large component meets itself.
    large = left.where(F.col("size") > paired)
    shares = large.groupBy("element", "root").agg(F.count(F.lit(1)).alias("c"))
    main = shares.groupBy("element").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("c"))
    main = materialize(main.where("c > most").select("element", "main", ((F.col("c") - F.col("most")) * F.col("c")).alias("rows")), "mains")
    large = crowded = materialize(large.join(main.drop("rows"), "element"), "crowded")
    members = large.select("fp", "n").distinct()
    if (main.agg(F.sum("rows")).first()[0] or 0) > (members.agg(F.sum("n")).first()[0] or 0):
        large = large.join(shared_counts(members.select("fp"), sets), "fp").where(F.col("held") >= F.lit(least) * F.col("n") - F.lit(1e-9))
    else:
        large = large.withColumn("held", F.col("n"))
    minor = large.where(F.col("root") != F.col("main"))
    across = large.select("element", *[F.col(c).alias(f"o_{c}") for c in ("fp", "n", "root", "held")])
    once = (F.col("o_root") == F.col("main")) | (F.col("fp") < F.col("o_fp"))
    can = F.least("held", "o_held") >= F.lit(least / (1 + least)) * (F.col("n") + F.col("o_n")) - F.lit(1e-6)
    met = minor.join(across, "element").where((F.col("root") != F.col("o_root")) & once & fits(F.col("n"), F.col("o_n")) & can)
    first = F.col("fp") < F.col("o_fp")
    met = met.select(
        F.least("fp", "o_fp").alias("a"), F.when(first, F.col("n")).otherwise(F.col("o_n")).alias("na"),
        F.greatest("fp", "o_fp").alias("b"), F.when(first, F.col("o_n")).otherwise(F.col("n")).alias("nb"),
    )
    counted = near.unionByName(met).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c")).where(enough(F.col("c"), F.col("na"), F.col("nb"), least))
    links = links.unionByName(verified(counted.select("a", "b"), sets, least))
    discard(left, shared, main, crowded)
    return connected_components(links)


def enough(common: Column, a: Column, b: Column, least: float) -> Column:
    """Whether sets of sizes ``a`` and ``b`` whose prefixes share ``common`` elements can have a similarity of ``least``.

    Of the set whose prefix ends first in the order, elements of the prefix that the other set has are in its prefix too;
    so the sets share at most those and the rest of that set.
    """
    rest = lambda n: F.ceil(F.lit(least) * n - F.lit(1e-9)) - 1
    return common + F.greatest(rest(a), rest(b)) >= F.lit(least / (1 + least)) * (a + b) - F.lit(1e-6)


def similar_groups(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE, least: float = LEAST, paired: int = PAIRED, distance: int = DISTANCE) -> DataFrame:
    """Columns ``keep`` and ``group_fp`` of every row: rows have the same one if links of ``least`` similarity or more join them.

    Text: A-Z in lower case, words between ASCII white space, distinct shingles of ``shingle`` words; a shorter text is one
    shingle, null and blank texts are one group. Shingles are told apart by 48-bit hashes, sets by 64-bit ones. Rows with
    the same set are joined before anything is paired. Repeated rows are copies like others; an empty table gives none.
    """
    every = written_sets(docs, keep, text, shingle)
    names = [f"k{i}" for i in range(len(keep))]
    sets = every.where("elements is not null").select("row", "fp", "sim", "n", "elements")
    firsts = materialize(sets.groupBy("fp").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("c")), "set-firsts")
    some, different = firsts.agg(F.sum("c"), F.count(F.lit(1))).first()
    if different and some > REPEATED * different:  # copies that many tasks have met
        rows = materialize(every.select(*names, "fp"), "rows")
        sets = materialize(with_dimension(sets, firsts.drop("c"), ["fp", "row"], "left_semi", NARROW_ROWS), "distinct-sets")
        discard(every)
        every, written = rows, [rows, sets]
    else:
        written = [every]
        if different and 0 < some - different <= NARROW_ROWS:  # a few of them are passed over where they lie
            again = with_dimension(sets.select("fp", "row"), firsts.where("c > 1").select("fp", F.col("row").alias("first")), ["fp"], "inner")
            copies = materialize(again.where("row != first").select("row"), "copies")
            sets = sets.join(F.broadcast(copies), "row", "left_anti")
    roots = similar_links(sets.drop("row"), least, paired, distance).withColumnRenamed("node", "fp")
    named = every.select(*names, "fp").join(roots, "fp", "left").withColumn("group_fp", F.coalesce("root", "fp"))
    groups = materialize(named.select(*names, "group_fp"), "groups")
    discard(*written)
    return with_names(groups, keep, "group_fp")


def one_per_similar(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, one of each group of ``similar_groups``, chosen as ``simhash.one_per_group`` does."""
    return first_of_groups(docs, id, text, lambda rows, keep: similar_groups(rows, keep, **options))

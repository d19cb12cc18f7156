"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints within ``distance`` bits agree up to ``t_i`` bits in some part ``i`` whenever the parts' thresholds
satisfy ``sum(t_i + 1) = distance + 1``. Correlated bits go into one part, dynamic programming gives the parts unequal
thresholds (-1: not probed) by the candidates and probes they are estimated to cost, and pairs that meet in a part are
verified on all bits. All of it runs on distinct fingerprints. A part's value that very many fingerprints share is
not paired: its members are linked through the fingerprints between them, which needs a fixed number of rows
for each member and finds exactly the pairs within the distance.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ragscale.llm.arrays import SPACE, text_buffers, text_slices, word_bounds
from ragscale.llm.components import connected_components
from ragscale.llm.frames import carry, with_names
from ragscale.operators.skew import with_dimension
from ragscale.session import materialize

BITS = 64
PAIRED = 64  # fingerprints of one part's value that are paired; larger sets are linked through their midpoints

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# For each byte eight counters of one byte each: its bits, the highest first.
_SPREAD = np.array([sum(((b >> (7 - i)) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def simhash_rows(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """Fingerprints (uint64) of all rows of a text column."""
    from xxhash import xxh64_intdigest

    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets)
    lengths = ends - starts
    begin = np.zeros(len(starts) + 1, np.int64)  # words laid out with one blank after each
    np.cumsum(lengths + 1, out=begin[1:])
    flat = np.full(begin[-1], 0x20, np.uint8)
    flat[np.arange(lengths.sum()) + np.repeat(np.arange(len(lengths)), lengths)] = _LOWER[data[~SPACE[data]]]
    words = np.diff(first)
    per = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    row_at = np.zeros(n + 1, np.int64)
    np.cumsum(per, out=row_at[1:])
    left = np.arange(row_at[-1]) + np.repeat(first[:-1] - row_at[:-1], per)
    right = left + np.repeat(np.minimum(shingle, words), per) - 1
    text = flat.tobytes()
    hashes = np.fromiter(
        (xxh64_intdigest(text[a:b], seed) for a, b in zip(begin[left].tolist(), (begin[right] + lengths[right]).tolist())),
        np.uint64, int(row_at[-1]),
    )
    return majority_bits(hashes, row_at)


def majority_bits(hashes: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """For each row the bits set in over half of ``hashes[row_at[i]:row_at[i + 1]]`` (uint64); 0 for a row without any."""
    per = np.diff(row_at)
    out = np.zeros(len(per), np.uint64)
    full = np.flatnonzero(per)
    if len(full):
        spread = _SPREAD[hashes.astype(">u8").view(np.uint8).reshape(-1, 8)]
        cuts = np.unique(np.concatenate([row_at[full], np.arange(0, row_at[-1], 255)]))  # 255 fit a one-byte counter
        sums = np.add.reduceat(spread, cuts, axis=0).astype("<u8").view(np.uint8).reshape(-1, BITS).astype(np.int64)
        ones = np.add.reduceat(sums, np.searchsorted(cuts, row_at[full]), axis=0)
        bits = (2 * ones > per[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def simhash(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Columns ``keep`` as ``k0, k1, ...`` and ``fp``, the 64-bit fingerprint of each row's text as bigint."""
    rows, _ = carry(docs, keep, F.col(text).cast("string"))
    names = [f"k{i}" for i in range(len(keep))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "x0"):
            data, offsets = text_buffers(part.column(len(keep)))
            fp = simhash_rows(data, offsets, shingle, seed).view(np.int64)
            yield pa.record_batch([*part.columns[: len(keep)], pa.array(fp)], names=[*names, "fp"])

    fields = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    return rows.mapInArrow(task, f"{fields}fp bigint")


def bit_statistics(fps: DataFrame, column: str = "fp") -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both set (64 x 64, from all rows)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                values = batch.column(0).slice(at, 1 << 16).to_numpy(zero_copy_only=False).astype(">i8")
                bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                both += bits.T @ bits
                total += len(values)
        if total:
            a, b = np.meshgrid(np.arange(BITS), np.arange(BITS), indexing="ij")
            yield pa.record_batch(
                [pa.array(a.ravel().astype(np.int32)), pa.array(b.ravel().astype(np.int32)), pa.array(both.ravel()), pa.array(np.full(BITS * BITS, total, np.int64))],
                names=["a", "b", "both", "n"],
            )

    rows = fps.select(column).mapInArrow(task, "a int, b int, both double, n bigint").groupBy("a", "b").agg(F.sum("both").alias("both"), F.sum("n").alias("n"))
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows.collect():  # 64 x 64 rows at most
        both[r["a"], r["b"]], n = r["both"], r["n"]
    return n, both


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of almost equal size, strongly correlated bits together (bit 0 is the highest)."""
    mean = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.outer(dev, dev)
    corr = np.abs(np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for i in range(parts):
        size = len(free) // (parts - i)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (corr[b, group].sum(), -b)))
            free.remove(group[-1])
        out.append(sorted(group))
    return out


def part_costs(n: int, both: np.ndarray, part: list[int], distance: int) -> list[float]:
    """Estimated rows for thresholds -1, 0, ..., distance: probes sent plus pairs that meet."""
    share = np.diag(both)[part] / max(n, 1)
    differ = 2 * share * (1 - share)
    at = np.zeros(distance + 1)  # probability of 0, 1, ... differing bits in the part
    at[0] = 1
    for q in differ:
        at[1:] = at[1:] * (1 - q) + at[:-1] * q
        at[0] *= 1 - q
    costs = [0.0]
    for t in range(distance + 1):
        probes = sum(math.comb(len(part), e) for e in range(t + 1)) + (1 if t else 0)
        costs.append(n * probes + n * (n - 1) / 2 * at[: t + 1].sum())
    return costs


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost with ``sum(t + 1) = distance + 1``, by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for spent, more in enumerate(cost):
                key = used + spent
                if key <= distance + 1 and (key not in nxt or total + more < nxt[key][0]):
                    nxt[key] = (total + more, chosen + [spent - 1])
        best = nxt
    return best[distance + 1]


def plan_parts(n: int, both: np.ndarray, distance: int, max_parts: int = 6) -> list[tuple[list[int], int]]:
    """Probed parts and their thresholds: the cheapest of the partitions into 1 to ``max_parts`` groups."""
    options = []
    for m in range(1, max_parts + 1):
        parts = correlated_parts(n, both, m)
        total, chosen = allocate([part_costs(n, both, p, distance) for p in parts], distance)
        options.append((total, m, [(p, t) for p, t in zip(parts, chosen) if t >= 0]))
    return min(options)[2]


def _mask(bits) -> int:
    value = sum(1 << (BITS - 1 - b) for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _near(value: Column, bits: list[int], most: int) -> Column:
    """``value`` with up to ``most`` of ``bits`` flipped, as an array."""
    masks = [_mask(c) for e in range(most + 1) for c in combinations(bits, e)]
    return F.transform(F.lit(masks).cast("array<bigint>"), lambda m: value.bitwiseXOR(m))


def near_links(fps: DataFrame, distance: int = 2, paired: int = PAIRED, plan: list | None = None) -> DataFrame:
    """``a, b`` links over distinct fingerprints (column ``fp``) whose closure joins exactly those within ``distance``.

    Every link joins two fingerprints within ``distance``; a crowded value yields enough of them to join the same
    components as all its pairs. ``fps`` should be a written table; it is read several times.
    """
    if plan is None:
        plan = plan_parts(*bit_statistics(fps), distance)
    half, rest = distance // 2, distance - distance // 2
    out = None
    for number, (part, allowed) in enumerate(plan):
        mask = _mask(part)
        keyed = fps.select("fp", F.col("fp").bitwiseAND(F.lit(mask)).alias("key"))
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1") if not allowed else None
        if allowed:
            # Probing within a few bits: one side sends its neighbours, the other stays; both ends of a pair probe.
            probes = fps.select(F.col("fp").alias("a"), F.explode(_near(F.col("fp").bitwiseAND(F.lit(mask)), part, allowed)).alias("key"))
            counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
            base = keyed.join(counts, "key")
            pairs = probes.join(base.where(F.col("n") <= paired), "key").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
            links = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
            crowd = base.where(F.col("n") > paired).select(F.col("fp").alias("member"), F.lit(None).cast("bigint").alias("key"))
            crowd = crowd.unionByName(probes.join(counts.where(F.col("n") > paired), "key").select(F.col("a").alias("member"), F.lit(None).cast("bigint").alias("key"))).distinct()
            free = list(range(BITS))
        else:
            grouped = keyed.join(sizes, "key")
            small = grouped.where(F.col("n") <= paired)
            sets = small.groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))  # at most ``paired`` of them
            pairs = sets.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", lambda x: (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= distance))).alias("b"))
            links = pairs
            crowd = grouped.where(F.col("n") > paired).select(F.col("fp").alias("member"), "key")
            free = [b for b in range(BITS) if b not in set(part)]
        # Members of a crowded value within the distance have a common fingerprint half way between them, at most
        # ``half`` bits from one of them and ``rest`` bits from the other.
        near = F.transform(_near(F.col("member"), free, rest), lambda m: F.struct(m.alias("middle"), (F.bit_count(m.bitwiseXOR(F.col("member"))) <= half).alias("inner")))
        middles = crowd.select("member", F.explode(near).alias("_m")).select("member", "_m.*")
        met = middles.groupBy("middle").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("inner"), F.col("member"))).alias("a"))
        bridges = middles.join(met.where("n > 1 and a is not null"), "middle")
        links = links.unionByName(bridges.select("a", F.col("member").alias("b")).where(F.col("a") != F.col("b")))
        out = links if out is None else out.unionByName(links)
    return out.distinct()


def near_duplicates(docs: DataFrame, keep: list[str], id: str = "doc_id", text: str = "text", distance: int = 2, shingle: int = 3, seed: int = 42, paired: int = PAIRED) -> DataFrame:
    """Columns ``keep`` (``id`` among them), ``fp``, ``component_id`` and ``group_fp`` of every row, repeated rows included.

    Text: A-Z in lower case, words between ASCII white space, shingles of ``shingle`` words with repeats; a shorter
    text is one shingle. Null and blank texts have fingerprint 0 and are linked like any other. ``component_id`` is
    the smallest non-null id that links of at most ``distance`` differing bits reach, the row's own included; null if all
    those ids are null. ``group_fp`` names the component also then: its smallest fingerprint. Copies share a fingerprint
    and are joined before anything is paired. An empty table gives none.
    """
    hashed = materialize(simhash(docs, keep, text, shingle, seed), "simhash")
    fps = materialize(hashed.groupBy("fp").agg(F.min(f"k{keep.index(id)}").alias("first_id")), "fingerprints")
    roots = connected_components(near_links(fps.select("fp"), distance, paired))
    linked = roots.join(fps, roots["node"] == fps["fp"]).select("fp", "root", "first_id")
    best = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    merged = linked.join(best, "root").select("fp", "root", F.col("component_id").alias("merged_id"))
    named = fps.join(merged, "fp", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("merged_id")).alias("component_id"), F.coalesce("root", "fp").alias("group_fp")
    )
    return with_names(hashed.join(named, "fp"), keep, "fp", "component_id", "group_fp")


def one_per_group(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate group, chosen by ``first_of_groups``."""
    return first_of_groups(docs, id, text, lambda rows, keep: near_duplicates(rows, keep, "id", "text", **options))


def first_of_groups(docs: DataFrame, id: str, text: str, groups: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """The rows of ``docs``, one of each group: that with the smallest id (null last), then the smallest text hash,
    then the smallest hash of all its columns. All columns stay as they are. Texts are shuffled once at most; of a repeated
    row each task sends one copy.

    ``groups`` adds ``group_fp`` to the columns named, given rows with ``id``, ``text`` and these.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(id).cast("string")), F.lit(""))  # tells null from every value
    mark = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    narrow = groups(docs.select(F.col(id).alias("id"), key.alias("key"), mark.alias("mark"), F.col(text).alias("text")), ["id", "key", "mark"])
    first = narrow.groupBy("group_fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "mark", "key")).alias("first"))
    chosen = materialize(first.select("first.key", "first.mark").distinct(), "chosen")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), mark.alias("mark"))
    repeated = whole.groupBy("key", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if repeated:  # copies of a row are brought down to one before anything is shuffled
        whole = whole.groupBy("key", "mark").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return with_dimension(whole, chosen, ["key", "mark"], "left_semi", 1_000_000).select("row.*")


def fingerprint_hex(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

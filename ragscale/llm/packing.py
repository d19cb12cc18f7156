"""Packing documents into windows whose sources keep target proportions.

Each source's tokens form a queue, cut into cells. A window is filled by deficit round-robin: a source earns its share of
every window, is served a cell when it has earned one, and carries what it has earned but not received into the next
window. In virtual time that is an order of all cells: cell ``j`` of a source with weight ``w`` is due at ``(j + 1/2) / w``, so
the place of any cell follows from the queues' lengths alone, a task packs its documents without seeing any others, and
deficits carry across windows and tasks alike. With very many sources the cells themselves are numbered in that order by
range partitions, and documents look theirs up; the result is the same. What is left of the queues fills further windows and then windows of
powers of two, so that nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ragscale.llm.arrays import SLICE_BYTES, held, let_go, ragged_ranges, text_buffers, text_slices
from ragscale.llm.order import numbered
from ragscale.llm.word_tokens import MAX_CELLS, WordTokenizer
from ragscale.operators.skew import with_dimension
from ragscale.session import materialize

LENGTH, CELL, QUEUES = 2048, 128, 256
RUN = 4096  # cells of a source that are made at once
ID = np.dtype("<u2")  # stored ids; the vocabulary must fit


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, id: str, text: str, source: str, slice_bytes: int = SLICE_BYTES, max_cells: int = MAX_CELLS) -> DataFrame:
    """Written ``id, block, source, start, n, ids``: each row's ids as bytes (16 bits each), and its place among its source's
    ids in its block.

    A block is a task of this stage; it is fixed by being written.
    """
    rows = docs.select(
        F.col(id).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source"), F.col(text).cast("string").alias("text")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, used = TaskContext.get().partitionId(), {}
        for part in text_slices(batches, "text", slice_bytes):
            flat, at = held(WordTokenizer, vocabulary, max_cells).ids(part.column(2))
            if len(flat) and flat.max() > np.iinfo(ID).max:
                raise ValueError("the vocabulary has ids of more than 16 bits")
            n = np.diff(at) + 1
            ends = np.cumsum(n)
            ids, body = np.full(ends[-1], end_id, ID), np.ones(ends[-1], bool)
            body[ends - 1] = False
            ids[body] = flat
            starts = []
            for name, size in zip(part.column(1).to_pylist(), n.tolist()):
                starts.append(used.get(name, 0))
                used[name] = starts[-1] + size
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.concatenate([[0], ends]) * 2).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.record_batch(
                [part.column(0), pa.array(np.full(len(n), block, np.int64)), part.column(1), pa.array(starts, pa.int64()), pa.array(n), packed],
                names=["id", "block", "source", "start", "n", "ids"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.mapInArrow(task, f"id {kind}, block bigint, source string, start bigint, n bigint, ids binary"), "tokens")


def queue_places(tokens: DataFrame, weights: dict | None, most_queues: int) -> tuple[DataFrame, DataFrame, list[tuple[int, float]] | None]:
    """Where each block's part of a source begins in its queue (``block, source, base``), the sources' tokens and weights
    (``source, n, w``), and the latter by name as a list, if there are less than ``most_queues``."""
    spark = tokens.sparkSession
    totals = materialize(tokens.groupBy("block", "source").agg(F.sum("n").alias("n")), "totals")
    sources = totals.groupBy("source").agg(F.sum("n").alias("n"))
    if weights:
        share = spark.createDataFrame([("=" + k if k is not None else "", float(v)) for k, v in weights.items()], "source string, w double")
        sources = with_dimension(sources, share, ["source"]).withColumn("w", F.coalesce("w", F.lit(0.0)))
    else:
        sources = sources.withColumn("w", F.col("n").cast("double"))
    sources = materialize(sources, "sources")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("block")) - F.col("n")
    places = materialize(totals.select("block", "source", before.alias("base")), "places")
    few = sources.orderBy("source").limit(most_queues).collect()
    return places, sources, [(r["n"], r["w"]) for r in few] if len(few) < most_queues else None


def running(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each in ``order`` (distinct): ranges apart, then their sums."""
    ranged = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    before, total = [], 0
    for r in sorted(ranged.groupBy("_part").agg(F.sum(value).alias("s")).collect()):  # one row for each range
        before.append((r["_part"], total))
        total += r["s"]
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before bigint")
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(order)) - F.col(value)
    return ranged.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_inside")).alias(out))


def many_queues(tokens: DataFrame, places: DataFrame, sources: DataFrame, length: int, cell: int) -> tuple[DataFrame, Sequences]:
    """Rows ``id, first, n, ids, cells, tail_at, ranks`` for any number of sources, and the sequences."""
    lowest = sources.where("w > 0").agg(F.min(F.col("w") / F.greatest("n", F.lit(1)))).first()[0]
    weight = F.when(F.col("w") > 0, F.col("w")).otherwise(F.greatest("n", F.lit(1)) * F.lit(1.0 if lowest is None else lowest)) / F.lit(cell)
    sized = sources.select("source", weight.alias("w"), F.floor(F.col("n") / cell).alias("cells"), (F.col("n") % cell).alias("tail"))
    sized = materialize(running(sized, "source", "tail", "tail_at"), "tails")
    runs = sized.where("cells > 0").select("source", "w", "cells", F.explode(F.sequence(F.lit(0), F.floor((F.col("cells") - 1) / RUN))).alias("r"))
    each = runs.select("source", "w", F.explode(F.sequence(F.col("r") * RUN, F.least(F.col("cells"), (F.col("r") + 1) * RUN) - 1)).alias("j"))
    ranked, total = numbered(each.select("source", "j", ((F.col("j") + F.lit(0.5)) / F.col("w")).alias("due")), [F.col("due"), F.col("source")])
    rest = sized.agg(F.sum("tail")).first()[0]
    key = ["block", "source", "start"]  # one row each: every row has an id at least
    at = with_dimension(with_dimension(tokens, places, ["block", "source"]), sized.drop("w", "tail"), ["source"]).withColumn("first", F.col("base") + F.col("start"))
    last = F.least(F.floor((F.col("first") + F.col("n") - 1) / cell), F.col("cells") - 1)
    spans = at.select(*key, F.floor(F.col("first") / cell).alias("lo"), last.alias("hi")).where("lo <= hi")
    asked = spans.select(*key, F.explode(F.sequence("lo", "hi")).alias("j")).join(ranked.select("source", "j", "rank"), ["source", "j"])
    told = asked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("j", "rank")))["rank"].alias("ranks"))  # cells of one document
    none = F.array().cast("array<bigint>")
    rows = at.join(told, key, "left").select("id", "first", "n", "ids", "cells", "tail_at", F.coalesce("ranks", none).alias("ranks"))
    return rows, Sequences(total, rest, length, cell)


PLACED_BYTES = 2 << 20  # ids, two bytes each, that are placed at once


class Sequences:
    """Windows of cells, and the line of what is left after them."""

    def __init__(self, cells: int, tails: int, length: int = LENGTH, cell: int = CELL):
        self.length, self.cell, self.per = length, cell, length // cell
        self.windows = cells // self.per
        self.loose = (cells - self.windows * self.per) * cell  # tokens of cells beyond the last full window
        rest = self.loose + tails
        steps = [length] * (rest // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if (rest % length) >> b & 1]
        self.cuts = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)

    def laid(self, first: np.ndarray, n: np.ndarray, cells: np.ndarray, tail_at: np.ndarray, ranked: Callable) -> tuple[np.ndarray, ...]:
        """``row, start, length, sequence, offset`` of the pieces of documents at ``first`` in queues of ``cells`` full cells, whose
        tails begin at ``tail_at`` behind the loose cells. ``ranked`` gives the places of a row's full cells, in order."""
        lo, hi = first // self.cell, (first + n - 1) // self.cell
        row = np.repeat(np.arange(len(n)), hi - lo + 1)
        j = ragged_cells(lo, hi)
        a, b = np.maximum(first[row], j * self.cell), np.minimum((first + n)[row], (j + 1) * self.cell)
        full = j < cells[row]
        rank = np.zeros(len(j), np.int64)
        rank[full] = ranked(row[full], j[full])
        seq, offset = rank // self.per, rank % self.per * self.cell + a - j * self.cell
        late = ~full | (seq >= self.windows)
        line = np.where(full, (rank - self.windows * self.per) * self.cell, self.loose + tail_at[row])[late] + (a - j * self.cell)[late]
        start, size = a - first[row], b - a
        if not late.any():
            return self._joined(row, start, size, seq, offset)
        # What lies on the line after the last full window is cut at the ends of the sequences there.
        k0, k1 = np.searchsorted(self.cuts, line, "right") - 1, np.searchsorted(self.cuts, line + size[late] - 1, "right") - 1
        part, k = np.repeat(np.arange(len(line)), k1 - k0 + 1), ragged_cells(k0, k1)
        x, y = np.maximum(line[part], self.cuts[k]), np.minimum((line + size[late])[part], self.cuts[k + 1])
        parts = (row[late][part], start[late][part] + x - line[part], y - x, self.windows + k, x - self.cuts[k])
        early = [c[~late] for c in (row, start, size, seq, offset)]
        return self._joined(*(np.concatenate([e, p]) for e, p in zip(early, parts)))

    @staticmethod
    def _joined(row, start, size, seq, offset):
        """Pieces that follow each other in both the document and the sequence become one."""
        order = np.lexsort((start, row))
        row, start, size, seq, offset = (c[order] for c in (row, start, size, seq, offset))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (seq[1:] != seq[:-1]) | (offset[1:] != offset[:-1] + size[:-1])
        at = np.flatnonzero(new)
        return row[at], start[at], np.add.reduceat(size, at) if len(at) else size, seq[at], offset[at]


class Layout(Sequences):
    """Places of cells in windows, from the queues' lengths and weights."""

    def __init__(self, queues: list[tuple[int, float]], length: int = LENGTH, cell: int = CELL):
        self.sizes = np.array([n for n, _ in queues], np.int64)
        self.cells = self.sizes // cell
        lowest = min((w / max(n, 1) for n, w in queues if w > 0), default=1.0)
        # A queue without a weight is drained at the slowest pace that the others have.
        self.weights = np.array([w if w > 0 else max(n, 1) * lowest for n, w in queues]) / cell
        tails = self.sizes - self.cells * cell
        self.tail_at = np.cumsum(tails) - tails
        super().__init__(int(self.cells.sum()), int(tails.sum()), length, cell)

    def due(self, queue: int, j: np.ndarray) -> np.ndarray:
        return (j + 0.5) / self.weights[queue]

    def ranks(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Position of full cells in the order of all cells by due time, then queue."""
        when = (j + 0.5) / self.weights[queue]
        out = j.copy()
        for q in range(len(self.cells)):
            if not self.cells[q]:
                continue
            other = queue != q
            t, tie = when[other], q < queue[other]
            c = np.clip(np.floor(t * self.weights[q] + 0.5).astype(np.int64), 0, self.cells[q])
            while True:  # exact by the same comparison that orders the cells; the estimate is off by one at most
                prior = self.due(q, c - 1)
                down = (c > 0) & ((prior > t) | ((prior == t) & ~tie))
                own = self.due(q, c)
                up = ~down & (c < self.cells[q]) & ((own < t) | ((own == t) & tie))
                if not (down.any() or up.any()):
                    break
                c = c - down + up
            out[other] += c
        return out

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pieces of documents at ``first`` in their queues."""
        return self.laid(first, n, self.cells[queue], self.tail_at[queue], lambda row, j: self.ranks(queue[row], j))


def ragged_cells(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """``lo, lo + 1, ..., hi`` of every pair, one after the other."""
    n = hi - lo + 1
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 1, id: str = "doc_id", text: str = "text", source: str = "source", weights: dict | None = None,
    length: int = LENGTH, cell: int = CELL, most_queues: int = QUEUES, with_ids: bool = False, slice_bytes: int = SLICE_BYTES,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Pieces ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, their ``ids``.

    ``weights``: target share of each source's tokens in a window; by default its share of all tokens. A source that runs
    dry leaves its room to the others. ``length`` is a power of two and a multiple of ``cell``. Each id of a document (its text's
    ids, then ``end_id``) lies in one piece, each sequence is full from 0 on; all but the last few have ``length`` ids, those have
    powers of two. Null text is empty and null sources are a source; ids may repeat or be null. Memory is bounded by a slice of texts
    (``slice_bytes``, or one longer text) and the vocabulary's transitions (``max_cells``).
    Equal due times go by queue, queues by name. No rows give no pieces. Other columns are not read.
    """
    tokens = tokenized(docs, vocabulary, end_id, id, text, source, slice_bytes, max_cells)
    places, sources, queues = queue_places(tokens, weights, most_queues)
    if queues is None:
        rows, layout = many_queues(tokens, places, sources, length, cell)
    else:
        layout = Layout(queues, length, cell)
        names = [r["source"] for r in sources.select("source").orderBy("source").collect()]  # less than ``most_queues``
        numbers = tokens.sparkSession.createDataFrame([(i, x) for i, x in enumerate(names)], "queue int, source string")
        placed = with_dimension(with_dimension(tokens, places, ["block", "source"]), numbers, ["source"])
        rows = placed.select("id", (F.col("base") + F.col("start")).alias("first"), "n", "ids", "queue")
    kind = rows.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in text_slices(batches, "ids", PLACED_BYTES):
            first, n, queue_or_cells = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 4))
            flat = text_buffers(batch.column(3))[0].view(ID).astype("<u4")
            if isinstance(layout, Layout):
                row, start, size, seq, offset = layout.pieces(queue_or_cells, first, n)
            else:
                ranks = batch.column(6).flatten().to_numpy()
                row, start, size, seq, offset = layout.laid(first, n, queue_or_cells, batch.column(5).to_numpy().astype(np.int64), lambda row, j, ranks=ranks: ranks)
            at = (np.cumsum(n) - n)[row] + start
            view = memoryview(flat).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + s)]) for a, s in zip(at.tolist(), size.tolist())]
            columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(offset)]
            names = [id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cut, offsets = ragged_ranges(flat.view(np.int32), at, size)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(cut)))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    fields = f"`{id}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return rows.mapInArrow(task, fields + (", ids array<int>" if with_ids else ""))

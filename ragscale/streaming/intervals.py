"""Bootstrap intervals over records as they arrive, from mergeable state.

The weights of a record in all replicates depend on its key alone, so sums of weights and of weighted scores can be added
up in any order. One state holds them for each configuration and salt; a micro-batch updates the states of the
configurations that got records and sends out only those. The latest states, added up, give the same intervals
as ``poisson_ci`` over all records at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ragscale.functions.hashing import stable_pair
from ragscale.functions.scoring import or_zero
from ragscale.operators.bootstrap import WEIGHTS, _poisson_sums, coefficients, combined_intervals, row_key_text
from ragscale.schemas import BOOTSTRAP_RESAMPLES, BOOTSTRAP_SEED, CONFIDENCE_LEVEL, CONFIG_KEY
from ragscale.session import work_path

SALTS = 4  # states that a configuration's records are dealt over
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_DOUBLES = T.ArrayType(T.DoubleType())
_STATE = T.StructType([
    T.StructField("epoch", T.LongType()), T.StructField("n", T.LongType()), T.StructField("weights", _DOUBLES),
    T.StructField("sums", _DOUBLES), T.StructField("means", _DOUBLES), T.StructField("squares", _DOUBLES),
])
_OUT = T.StructType([T.StructField("_group", T.StringType()), T.StructField("_salt", T.IntegerType()), *_STATE.fields])


class ReplicateSums(StatefulProcessor):
    """The state of one configuration and salt: count, replicate sums, and means with sums of squared deviations.

    ``epoch`` is the key of the first record, which tells a state apart from one that expired before it.
    """

    def __init__(self, coefficients: np.ndarray, n_metrics: int, idle_ms: int | None):
        self.by, self.n_metrics, self.idle_ms = coefficients, n_metrics, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sums", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        r, m = self.by.shape[1], self.n_metrics
        held = self.state.get()
        if held is None:
            epoch, n, weights, sums = None, 0, np.zeros(r), np.zeros((r, m))
            means, squares = np.zeros(m), np.zeros(m)
        else:
            epoch, n = held[0], held[1]
            weights, sums, means, squares = (np.asarray(x, dtype=float) for x in held[2:])
            sums = sums.reshape(r, m)
        latest = 0
        for pdf in rows:
            if not len(pdf):
                continue
            columns = [pdf.iloc[:, i] for i in range(pdf.shape[1])]  # by place: the frames' column names are not the stream's
            k1, k2, times = (columns[i].to_numpy(np.int64) for i in (1, 2, 3))
            values = np.column_stack([columns[4 + i].to_numpy(float) for i in range(m)])
            epoch = int(k1.min()) if epoch is None else epoch
            more, added = _poisson_sums(k1, k2, values, self.by)
            weights, sums = weights + more, sums + added
            here, of = values.mean(axis=0), len(values)
            squares = squares + ((values - here) ** 2).sum(axis=0) + (here - means) ** 2 * n * of / (n + of)
            means = means + (here - means) * of / (n + of)
            n += of
            latest = max(latest, int(times.max()))
        state = (epoch, n, weights.tolist(), sums.ravel().tolist(), means.tolist(), squares.tolist())
        self.state.update(state)
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame({f.name: [v] for f, v in zip(_OUT.fields, (key[0], int(key[1]), *state))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def running_sums(
    stream: DataFrame, record_key: list[str], keys: list[str] = CONFIG_KEY, metrics: list[str] | None = None,
    late_after: str | None = None, event_time: str = "timestamp", idle_ms: int | None = None,
    n_resamples: int = BOOTSTRAP_RESAMPLES, seed: int = BOOTSTRAP_SEED, salts: int = SALTS,
) -> DataFrame:
    """The stream of changed states. A record delivered twice counts once; a missing metric counts as 0.0.

    ``late_after`` bounds the keys remembered against re-deliveries to records younger than that; with ``idle_ms`` as well, a
    configuration without records for that long in event time gives up its state. Its sums stay, and later records start
    another state that is added to them.
    """
    metrics = metrics or ["cu"]
    stream.sparkSession.conf.set(_PROVIDER, _ROCKS)  # the store that such states need
    if late_after:
        once = stream.withWatermark(event_time, late_after).dropDuplicatesWithinWatermark([*keys, *record_key])
    else:
        once = stream.dropDuplicates([*keys, *record_key])
    row, more = stable_pair(row_key_text(record_key))
    time = F.unix_millis(F.col(event_time)) if late_after else F.lit(0).cast("bigint")
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    values = [or_zero(F.col(m).cast("double")).alias(f"_v{i}") for i, m in enumerate(metrics)]
    rows = once.select(group.alias("_group"), row.alias("_row"), more.alias("_more"), time.alias("_time"), *values)
    salted = rows.withColumn("_salt", F.pmod(F.col("_more"), F.lit(salts)).cast("int"))
    processor = ReplicateSums(coefficients(WEIGHTS, n_resamples, seed), len(metrics), idle_ms if late_after else None)
    mode = "EventTime" if late_after and idle_ms is not None else "None"
    return salted.groupBy("_group", "_salt").transformWithStateInPandas(processor, _OUT, "Update", mode)


def drain_intervals(
    states: DataFrame, like: DataFrame, keys: list[str] = CONFIG_KEY, metrics: list[str] | None = None,
    confidence: float = CONFIDENCE_LEVEL, name: str = "intervals", path: str | None = None,
) -> DataFrame:
    """Process everything available now; ``(keys, n, metric, mean, ci_lo, ci_hi, std)`` like ``poisson_ci``.

    Each micro-batch writes the states that changed under its own number, so a batch that is run again replaces
    itself. ``like`` is a frame that has ``keys`` with their types; ``path`` continues an earlier run.
    """
    metrics = metrics or ["cu"]
    spark = states.sparkSession
    path = path or work_path(spark, name)
    spark.createDataFrame([], _OUT).write.mode("overwrite").parquet(f"{path}/states/batch=-1")  # stays if nothing arrives

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/states/batch={batch_id}")

    query = (
        states.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    written = spark.read.schema(T.StructType([*_OUT.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/states")
    own = ["_group", "_salt", "epoch"]
    rest = [f.name for f in _OUT.fields if f.name not in own]
    latest = written.groupBy(*own).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*own, "_s.*")
    return merged_intervals(latest, like, keys, metrics, confidence)


def merged_intervals(states: DataFrame, like: DataFrame, keys: list[str], metrics: list[str], confidence: float) -> DataFrame:
    """Intervals of states that are added up for each configuration."""
    schema = T.StructType([like.schema[k] for k in keys])
    states = states.withColumn("_k", F.from_json("_group", schema)).select(*[F.col("_k").getField(k).alias(k) for k in keys], "n", "weights", "sums", "means", "squares")
    m = len(metrics)
    total = Window.partitionBy(*keys)
    whole = F.sum("n").over(total)
    stats = states
    for i in range(m):
        stats = stats.withColumn(f"_m{i}", F.sum(F.col("means")[i] * F.col("n")).over(total) / whole)
    spread = [(F.sum(F.col("squares")[i] + F.col("n") * (F.col("means")[i] - F.col(f"_m{i}")) * (F.col("means")[i] - F.col(f"_m{i}")))).alias(f"_q{i}") for i in range(m)]
    stats = stats.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.first(f"_m{i}").alias(f"_m{i}") for i in range(m)], *spread)
    one = F.col("n") > 1
    stats = stats.select(*keys, "n", *[F.col(f"_m{i}").alias(f"{c}__mean") for i, c in enumerate(metrics)],
                         *[F.when(one, F.sqrt(F.col(f"_q{i}") / (F.col("n") - 1))).otherwise(0.0).alias(f"{c}__std") for i, c in enumerate(metrics)])
    every = lambda i: F.transform("weights", lambda _, b: F.get("sums", b * m + i)).alias(f"_s{i}")
    slices = [every(i) for i in range(m)]
    return combined_intervals(states.select(*keys, F.col("weights").alias("_w"), *slices), stats, keys, metrics, confidence)

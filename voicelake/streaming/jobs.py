"""Incremental jobs on Structured Streaming: each reads new files once (`availableNow`) and keeps its state in a checkpoint.

Every job is given its folders; a second run with the same checkpoint continues where the first one stopped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voicelake.functions.scoring import decide
from voicelake.operators.audit import charge_ledger, ledger_accounts
from voicelake.sources.sinks import replace_table


def _finish(writer) -> None:  # noqa: ANN001
    """Run until all files that are there now have been read, however long that takes."""
    writer.trigger(availableNow=True).start().awaitTermination()


def _stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def incremental_scan(spark: SparkSession, path: str, schema: T.StructType, out: str, checkpoint: str) -> None:
    """Append the rows of files not scanned yet; the file source remembers which ones were."""
    rows = _stream(spark, path, schema)
    _finish(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"))


def resume_dedupe(spark: SparkSession, path: str, schema: T.StructType, key: str, out: str, checkpoint: str) -> None:
    """Store one row of every key over all runs: the state store holds the keys, partitioned like them."""
    rows = _stream(spark, path, schema).dropDuplicates([key])
    _finish(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"))


def ledger_totals(spark: SparkSession, path: str, schema: T.StructType, source: str, size: str, cap: int, out: str, checkpoint: str) -> None:
    """Running total per source with the cap it may not pass: the state is one sum per source, kept by Spark."""
    totals = _stream(spark, path, schema).groupBy(source).agg(F.sum(size).alias("bytes"), F.count("*").alias("events")).withColumn("over_cap", F.col("bytes") > cap)
    _finish(totals.writeStream.foreachBatch(lambda batch, _: replace_table(spark, out, batch.write.parquet)).outputMode("complete").option("checkpointLocation", checkpoint))


def charge_stream(spark: SparkSession, path: str, schema: T.StructType, source: str, size: str, order: Sequence[str], cap: int, out: str, checkpoint: str) -> DataFrame:
    """Accepted and refused charges of each source under one cap for all files; a refused charge uses nothing of it.

    Charges are taken by micro-batch, and by `order` inside one. The state is what earlier batches have accepted; a batch
    that runs again reads the batches before it and replaces itself.
    """
    def store(batch: DataFrame, number: int) -> None:
        spent = _accounts(spark, source, out).where(F.col("batch") < number).agg(F.sum("bytes")).first()[0] if number else 0
        charged = charge_ledger(batch, cap - int(spent or 0), order, size)
        ledger_accounts(charged, source, size).write.mode("overwrite").parquet(f"{out}/batch={number}")

    _finish(_stream(spark, path, schema).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint))
    sums = ("bytes", "events", "refused_bytes", "refused")
    return _accounts(spark, source, out).groupBy(source).agg(*[F.sum(c).alias(c) for c in sums])


def _accounts(spark: SparkSession, source: str, out: str) -> DataFrame:
    return spark.read.schema(f"{source} string, bytes bigint, events bigint, refused_bytes bigint, refused bigint, batch int").parquet(out)


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed processors need, for the streams started inside."""
    name, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old)


class Accounts(StatefulProcessor):
    """One account per source: a charge that exceeds what is left of the cap is refused and not added."""

    def __init__(self, cap: int, size: str, order: Sequence[str]) -> None:
        self.cap, self.size, self.order = cap, size, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "bytes bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        charges = pd.concat(rows, ignore_index=True).sort_values(self.order, kind="stable")
        spent = self.spent.get()[0] if self.spent.exists() else 0
        accepted = []
        for size in charges[self.size].tolist():
            if size is None or size != size or size < 0:
                raise ValueError("a charge must be zero or more")
            accepted.append(spent + size <= self.cap)
            spent += size if accepted[-1] else 0
        self.spent.update((int(spent),))
        yield charges.assign(accepted=accepted)

    def close(self) -> None:
        pass


def charge_accounts(
    spark: SparkSession, path: str, schema: T.StructType, source: str, size: str, order: Sequence[str], cap: int, out: str, checkpoint: str, files_per_batch: int = 1000
) -> DataFrame:
    """Every charge read so far with `accepted`, under one cap for each source.

    The state is the accepted total of a source, and nothing of earlier batches is read again. Charges are taken by
    micro-batch, and by `order`, which must be total, inside one: a task sorts the charges that a batch of files holds for
    a source.
    """
    columns = [source, size, *order]
    types = T.StructType([f for f in schema.fields if f.name in columns] + [T.StructField("accepted", T.BooleanType())])
    rows = _stream(spark, path, schema, files_per_batch).select(*[f.name for f in types.fields[:-1]])
    charged = rows.groupBy(source).transformWithStateInPandas(Accounts(cap, size, order), types, "Append", "None")
    with _keyed_state(spark):
        _finish(charged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"))
    return spark.read.schema(types).parquet(out)


TALLY = "start timestamp, stop timestamp, n bigint, total double, top double"


class Tally(StatefulProcessor):
    """Count, sum and maximum of a key until it closes: once the watermark has passed `wait` after its last row, or, with
    `width`, once it has passed the end of the window. Rows older than the watermark come out as they are, marked late."""

    def __init__(self, keys: Sequence[str], wait_ms: int = 0, width_ms: int = 0) -> None:
        self.keys, self.wait, self.width = list(keys), wait_ms, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tally", "first bigint, last bigint, n bigint, total double, top double")

    def ends(self, first: int, last: int) -> int:
        return first // self.width * self.width + self.width if self.width else last + self.wait

    def row(self, key, kind: str, first, last, n, total, top) -> pd.DataFrame:  # noqa: ANN001
        named = {name: [value] * len(first) for name, value in zip(self.keys, key)}
        return pd.DataFrame({**named, "kind": kind, "start": pd.to_datetime(first, unit="ms"), "stop": pd.to_datetime(last, unit="ms"), "n": n, "total": total, "top": top})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        old = self.state.get() if self.state.exists() else None
        now, mark = old, timerValues.getCurrentWatermarkInMs()
        for part in rows:
            at = part["at_ms"].to_numpy()
            closed = at // self.width * self.width + self.width if self.width else at
            late = closed <= mark
            if late.any():
                values = part["value"].to_numpy()[late]
                yield self.row(key, "late", at[late], at[late], [1] * len(values), values, values)
            if not late.all():
                times, values = at[~late], part["value"].to_numpy()[~late]
                own = (int(times.min()), int(times.max()), len(times), float(values.sum()), float(values.max()))
                now = own if now is None else (min(now[0], own[0]), max(now[1], own[1]), now[2] + own[2], now[3] + own[3], max(now[4], own[4]))
        if now is not None and now != old:
            if old is not None:
                self.handle.deleteTimer(self.ends(old[0], old[1]))
            self.handle.registerTimer(self.ends(now[0], now[1]))
            self.state.update(tuple(now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        first, last, n, total, top = self.state.get()
        self.state.clear()
        yield self.row(key, "closed", [first], [last], [n], [total], [top])

    def close(self) -> None:
        pass


def tallies(
    rows: DataFrame, keys: Sequence[str], ts: str, value: str, out: str, checkpoint: str, delay: str, wait_ms: int = 0, width_ms: int = 0
) -> DataFrame:
    """(keys, kind, start, stop, n, total, top): closed tallies, each once, and the rows that came after the watermark.

    The watermark follows the largest event time less `delay`. Without its mark the time column would let Spark drop late
    rows before the processor sees them, so the processor gets the time as a number. Closed keys leave the state.
    """
    spark = rows.sparkSession
    marked = rows.withWatermark(ts, delay).select(*keys, F.unix_millis(ts).alias("at_ms"), F.col(value).cast("double").alias("value"))
    kinds = [T.StructField(k, marked.schema[k].dataType) for k in keys] + [T.StructField("kind", T.StringType())]
    types = T.StructType(kinds + T.StructType.fromDDL(TALLY).fields)
    found = marked.groupBy(*keys).transformWithStateInPandas(Tally(keys, wait_ms, width_ms), types, "Append", "EventTime")
    with _keyed_state(spark):
        _finish(found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"))
    return spark.read.schema(types).parquet(out)


def chunk_scores(spark: SparkSession, path: str, schema: T.StructType, threshold: float, out: str, checkpoint: str, wait_seconds: int = 60) -> DataFrame:
    """Score and decision of every file that is closed, and the number of its chunks that came too late to count.

    A file closes once event time has gone `wait_seconds` past its last chunk; it is then written once and forgotten.
    """
    found = tallies(_stream(spark, path, schema), ["file_id"], "ts", "score", out, checkpoint, "0 seconds", wait_ms=1000 * wait_seconds)
    closed = F.col("kind") == "closed"
    mine = lambda c: F.when(closed, F.col(c))
    files = found.groupBy("file_id").agg(
        F.min(mine("start")).alias("start"), (F.sum(mine("total")) / F.sum(mine("n"))).alias("score"), F.max(mine("top")).alias("max_score"),
        F.coalesce(F.sum(mine("n")), F.lit(0)).alias("chunks"), F.count_if(~closed).alias("late"))
    return files.withColumn("decision", decide(F.col("score"), threshold))


WINDOWS = "window bigint, kind string, n bigint, total double"


class WindowTally(StatefulProcessor):
    """Count and sum of every window of a block of windows, until the watermark has passed the window's end.

    A key is a block of neighbouring windows, so windows with few rows do not cost a call each: rows are added up by
    array, and the state is one row for the open windows of a block. Late rows come out added up by window.
    """

    def __init__(self, width_ms: int) -> None:
        self.width = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "start array<bigint>, n array<bigint>, total array<double>")

    def opened(self) -> pd.DataFrame:
        start, n, total = self.state.get() if self.state.exists() else ([], [], [])
        return pd.DataFrame({"start": np.array(start, "int64"), "n": np.array(n, "int64"), "total": np.array(total, "float64")})

    def keep(self, tallies: pd.DataFrame, before: pd.DataFrame) -> None:
        if len(before):
            self.handle.deleteTimer(int(before["start"].min()) + self.width)
        if len(tallies):
            self.handle.registerTimer(int(tallies["start"].min()) + self.width)
            self.state.update((tallies["start"].tolist(), tallies["n"].tolist(), tallies["total"].tolist()))
        else:
            self.state.clear()

    def rows(self, tallies: pd.DataFrame, kind: str) -> pd.DataFrame:
        return pd.DataFrame({"window": tallies["start"].to_numpy(), "kind": kind, "n": tallies["n"].to_numpy(), "total": tallies["total"].to_numpy()})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        before, mark, parts = self.opened(), timerValues.getCurrentWatermarkInMs(), []
        for part in rows:
            at = part["at_ms"].to_numpy()
            tally = pd.DataFrame({"start": at - at % self.width, "n": 1, "total": part["value"].to_numpy()}).groupby("start", as_index=False).sum()
            late = tally["start"] + self.width <= mark
            if late.any():
                yield self.rows(tally[late], "late")
            parts.append(tally[~late])
        self.keep(pd.concat([before, *parts]).groupby("start", as_index=False).sum(), before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        before = self.opened()
        closed = before["start"] + self.width <= timerValues.getCurrentWatermarkInMs()
        yield self.rows(before[closed], "closed")
        rest = before[~closed]
        if len(rest):
            self.handle.registerTimer(int(rest["start"].min()) + self.width)
            self.state.update((rest["start"].tolist(), rest["n"].tolist(), rest["total"].tolist()))
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def event_windows(
    spark: SparkSession, path: str, schema: T.StructType, ts: str, value: str, width_seconds: int, out: str, checkpoint: str, salts: int = 16, delay: str = "0 seconds", block: int = 8192
) -> DataFrame:
    """Count and sum of every window of event time that has closed, beside those of the rows that came after it closed.

    A key holds `block` neighbouring windows, and its rows are dealt to `salts` tallies, so neither many windows with few
    rows nor one that holds most rows makes a slow key. The time column is given as a number, as in `tallies`.
    """
    width = 1000 * width_seconds
    marked = _stream(spark, path, schema).withWatermark(ts, delay)
    at = F.unix_millis(ts)
    keyed = marked.select(F.floor(at / (width * block)).alias("block"), F.pmod(F.xxhash64(ts, value), F.lit(salts)).cast("int").alias("salt"), at.alias("at_ms"), F.col(value).cast("double").alias("value"))
    found = keyed.groupBy("block", "salt").transformWithStateInPandas(WindowTally(width), WINDOWS, "Append", "EventTime")
    with _keyed_state(spark):
        _finish(found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"))
    closed = F.col("kind") == "closed"
    part = lambda c, late: F.coalesce(F.sum(F.when(~closed if late else closed, F.col(c))), F.lit(0))
    sums = [part("n", False).alias("n"), part("total", False).alias("total"), part("n", True).alias("late"), part("total", True).alias("late_total")]
    return spark.read.schema(WINDOWS).parquet(out).groupBy(F.timestamp_millis("window").alias("start")).agg(*sums)

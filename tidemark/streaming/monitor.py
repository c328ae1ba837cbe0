"""Structured Streaming side of the telemetry monitor.

Summaries, flags and alert rules are the same functions as on tables; here are
the stateful pieces: alert cool-down, degradation state, reuse of recent
results, late rows, and running a stream over what is there now.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import telemetry as tm
from tidemark.operators.ranking import first_per_key
from tidemark.sources.files import drop_path, folders, path_exists
from tidemark.sources.tables import shared_dir
from tidemark.streaming import stateful


def run_available(stream: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """Process everything available now into a Parquet table in the shared folder and return that table."""
    return stream.sparkSession.read.schema(stream.schema).parquet(_drain(stream, name, mode))


def staged(stream: DataFrame, name: str) -> DataFrame:
    """The same, handed on as a stream of the written table.

    Spark does not chain this kind of keyed state behind a windowed aggregate in one query, so the
    aggregate and the alert state are two queries with a table between them.
    """
    return stream.sparkSession.readStream.schema(stream.schema).parquet(_drain(stream, name, "append"))


def _drain(stream: DataFrame, name: str, mode: str) -> str:
    root = _fresh(stream.sparkSession, name)
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return f"{root}/out"


def _fresh(spark: SparkSession, name: str) -> str:
    import uuid
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def summary_stream(stream: DataFrame, keys: Sequence[str], size: str, slide: str | None = None,
                   lateness: str = "10 minutes") -> DataFrame:
    """Windowed summary of a telemetry stream, emitted once per window when the watermark passes its end."""
    marked = stream.withWatermark("ts", lateness)
    return tm.sliding_summary(marked, keys, size, slide) if slide else tm.window_summary(marked, keys, size)


def session_stream(stream: DataFrame, key: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """Session summary of a telemetry stream."""
    return stream.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("session"), key).agg(
        F.count("*").alias("n"), F.avg("duration_ms").alias("avg_ms"))


def cooled_down_stream(fired: DataFrame, keys: Sequence[str], *, minutes: float = tm.COOLDOWN_MINUTES) -> DataFrame:
    """Emit an alert, with all its columns, only if the last emitted one of its key is at least ``minutes`` old.

    ``fired`` has ``at`` (seconds) and one row per key and tick, as the windowed
    summaries produce (see ``staged``); the state of a key is one number, kept in RocksDB.
    """
    stateful.use_rocksdb(fired.sparkSession)
    return stateful.cooled_down(fired, keys, minutes * 60.0)


def reused_stream(stream: DataFrame, key: str, ident: str, *, ts: str = "ts", ttl_seconds: float = 300.0,
                  lateness: str = "10 minutes") -> DataFrame:
    """Every request with ``reuse_of``, the request whose stored result answers it; null if it is computed anew.

    A result answers requests of the same content for ``ttl_seconds`` after it was *computed*; answers from it do not
    prolong its life. The state of a content is the time and id of its last computed result and goes when
    the watermark has passed its end. Rows of a content are walked in event time by jumps from one computed
    request to the next, so batch borders make no difference to rows that come in time.
    """
    rows = stream.withWatermark(ts, lateness).select(F.col(ident).alias("ident"), key, ts, (F.unix_micros(ts) / 1e6).alias("at"))
    schema = f"ident bigint, {key} string, at double, reuse_of bigint"

    def walk(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(batches)).sort_values(["at", "ident"])
        at, ids = frame["at"].to_numpy(), frame["ident"].to_numpy()
        reuse = pd.array([None] * len(at), dtype="Int64")
        start, (last, holder) = 0, state.get if state.exists else (None, None)
        if last is not None:
            start = int(at.searchsorted(last + ttl_seconds))
            reuse[:start] = holder
        while start < len(at):
            last, holder = float(at[start]), int(ids[start])
            stop = max(start + 1, int(at.searchsorted(last + ttl_seconds)))
            reuse[start + 1:stop] = holder
            start = stop
        state.update((last, holder))
        state.setTimeoutTimestamp(max(int((last + ttl_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"ident": ids, key: group[0], "at": at, "reuse_of": reuse})
    return rows.groupBy(key).applyInPandasWithState(walk, schema, "last double, holder bigint", "append", "EventTimeTimeout")


def late_rows(query: StreamingQuery) -> int:
    """Rows that arrived behind the watermark, over all batches; follows the query until it ends.

    Spark keeps only the last progress records, so they are read while the query runs and counted by batch; a
    ``stateful.ProgressLog`` that was added before the query started also answers after its end.
    """
    seen: dict[int, int] = {}
    while True:
        ended = query.awaitTermination(0.2)
        for p in query.recentProgress:
            seen[p["batchId"]] = sum(int(op["numRowsDroppedByWatermark"]) for op in p["stateOperators"])
        if ended or not query.isActive:
            return sum(seen.values())


class DegradationMonitor:
    """Degradation per component over a stream, kept as a small table per micro-batch.

    Only the first 10 and last 100 rows of a component matter, and both are
    found with row limits applied before the shuffle, so neither a busy
    component nor a long history grows the work.  Each batch writes its state to
    its own folder, so a batch that is run again overwrites the same result.
    """

    COLUMNS = ["at", "event_id", "component", "duration_ms", "memory_mb", "error_occurred", "accuracy"]

    def __init__(self, spark: SparkSession, name: str = "degradation", root: str | None = None, confidence: str | None = None):
        """``root`` (by default ``name`` in the shared folder) holds the state; a monitor with the same root goes on from it."""
        self.spark, self.confidence = spark, confidence
        self.root = root or f"{shared_dir(spark)}/{name}"

    def _state(self, epoch: int) -> str:
        return f"{self.root}/state/epoch={epoch}"

    def step(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch: merge its rows into the state and write the new report."""
        rows = batch.select(*dict.fromkeys([*self.COLUMNS, *([self.confidence] if self.confidence else [])]))
        if epoch > 0 and path_exists(self.spark, self._state(epoch - 1)):
            rows = rows.unionByName(self.spark.read.parquet(self._state(epoch - 1)))
        early = first_per_key(rows, ["component"], [F.col("at"), F.col("event_id")], tm.BASELINE_ROWS)
        late = first_per_key(rows, ["component"], [F.desc("at"), F.desc("event_id")], tm.TREND_ROWS)
        early.unionByName(late).dropDuplicates(["component", "event_id"]) \
            .write.mode("overwrite").parquet(self._state(epoch))
        report = tm.degradation(self.spark.read.parquet(self._state(epoch)), ["component"], accuracy="accuracy", confidence=self.confidence)
        report.write.mode("overwrite").parquet(f"{self.root}/report/epoch={epoch}")
        for folder in ("state", "report"):  # the batch before may have to be run again; older ones may not
            drop_path(self.spark, f"{self.root}/{folder}/epoch={epoch - 2}")

    def run(self, stream: DataFrame) -> DataFrame:
        """Process what is available now and return the latest report."""
        query = (stream.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.root}/checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        last = self.last
        if last is None:
            raise ValueError("no data has been seen yet")
        return self.spark.read.parquet(f"{self.root}/report/epoch={last}")

    @property
    def last(self) -> int | None:
        """Number of the last batch with a report, also of an earlier run."""
        found = folders(self.spark, f"{self.root}/report/epoch=*")
        return max((int(name.partition("=")[2]) for name in found), default=None)


def observed(df: DataFrame, name: str) -> DataFrame:
    """Count rows and failures as they pass (for a progress display or listener); the data is unchanged."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error_occurred")).alias("errors"))


def score(df: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a user's model to Arrow batches of a table or stream.

    ``predict`` gets and returns a frame.  If a batch fails its halves are tried,
    and so on; rows that fail alone come out with null results and the reason in
    ``error``; the output has the columns of ``schema`` plus ``error``.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from _tried(predict, frame, names)
    return df.mapInPandas(run, f"{schema}, error string")


def _tried(predict: Callable[[pd.DataFrame], pd.DataFrame], frame: pd.DataFrame, names: list[str]) -> Iterator[pd.DataFrame]:
    try:
        yield predict(frame)[names].assign(error=None)
    except Exception as problem:
        if len(frame) > 1:
            yield from _tried(predict, frame.iloc[:len(frame) // 2], names)
            yield from _tried(predict, frame.iloc[len(frame) // 2:], names)
        else:
            known = {n: frame[n].tolist() if n in frame.columns else [None] for n in names}
            yield pd.DataFrame(known).assign(error=f"{type(problem).__name__}: {problem}")

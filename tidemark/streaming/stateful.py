"""Alert cool-down as a stateful processor, and a log of what streams report while they run."""

from __future__ import annotations

import math
import threading
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "run_id string, name string, batch_id bigint, at string, input_rows bigint, late_rows bigint, state_rows bigint, watermark string"


class Cooldown(StatefulProcessor):
    """Emits a key's first alert, then always the first one at least ``gap`` seconds after the last emitted.

    State of a key: the time of the last emitted alert, and between two frames of a batch the alerts waiting for their turn, by the
    stretch of ``gap`` seconds they fall in. Stretches are walked in order and given up at once, so that a worker holds one frame
    and one stretch, however many alerts of a key come in a batch; alerts of the same moment count once.
    """

    def __init__(self, keys: Sequence[str], gap: float, ttl_days: float | None = None):
        self.keys, self.gap = list(keys), gap
        self.ttl = None if ttl_days is None else int(ttl_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at double", self.ttl)
        self.waiting = handle.getMapState("waiting", "stretch bigint", "at array<double>, payload array<string>", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stretches: set[int] = set()
        for frame in rows:
            for stretch, part in frame.groupby((frame["at"] // self.gap).astype("int64")):
                merged = dict(zip(*self.waiting.getValue((stretch,)))) if self.waiting.containsKey((stretch,)) else {}
                for at, payload in zip(part["at"].tolist(), part["payload"].tolist()):
                    merged[at] = min(payload, merged.get(at, payload))
                self.waiting.updateValue((stretch,), (list(merged), list(merged.values())))
                stretches.add(int(stretch))
        last = self.last.get()[0] if self.last.exists() else -math.inf
        for stretch in sorted(stretches):
            chosen = []
            for at, payload in sorted(zip(*self.waiting.getValue((stretch,)))):
                if last + self.gap <= at:
                    last = at
                    chosen.append((*key, at, payload))
            self.waiting.removeKey((stretch,))
            if chosen:
                yield pd.DataFrame(chosen, columns=[*self.keys, "at", "payload"])
        if last > -math.inf:
            self.last.update((last,))

    def close(self) -> None:
        pass


def cooled_down(fired: DataFrame, keys: Sequence[str], gap: float, ttl_days: float | None = None) -> DataFrame:
    """The alerts of a stream that are emitted, with all their columns; ``at`` is a time in seconds.

    The payload goes through the state as one JSON text. With ``ttl_days`` a key that has been silent so long on the
    clock is forgotten. The session must keep state in RocksDB (``use_rocksdb``).
    """
    rest = [c for c in fired.columns if c not in (*keys, "at")]
    packed = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    slim = fired.select(*keys, F.col("at").cast("double").alias("at"), packed.alias("payload"))
    schema = StructType([*slim.select(*keys).schema.fields, StructField("at", DoubleType()), StructField("payload", StringType())])
    out = slim.groupBy(*keys).transformWithStateInPandas(
        Cooldown(keys, gap, ttl_days), schema, "append", "None" if ttl_days is None else "ProcessingTime")
    time = F.col("at").cast(fired.schema["at"].dataType)
    if not rest:
        return out.select(*keys, time.alias("at"))
    content = F.from_json("payload", fired.select(*rest).schema)
    return out.select(*keys, time.alias("at"), content.alias("content")).select(*keys, "at", "content.*").select(*fired.columns)


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams started from now on in RocksDB, on each executor's disk and in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class ProgressLog(StreamingQueryListener):
    """Every batch of the streams of a session, over their whole life: one small record each, kept on the driver."""

    def __init__(self) -> None:
        self._records: dict[tuple[str, int], tuple] = {}
        self._ended: set[str] = set()
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(int(op.numRowsDroppedByWatermark) for op in p.stateOperators)
        kept = sum(int(op.numRowsTotal) for op in p.stateOperators)
        record = (str(p.runId), p.name, int(p.batchId), p.timestamp, int(p.numInputRows), late, kept, dict(p.eventTime or {}).get("watermark"))
        with self._changed:
            self._records[record[0], record[2]] = record  # a batch reported again replaces itself

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def settled(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Wait for the query's end and for its last report."""
        query.awaitTermination()
        with self._changed:
            if not self._changed.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError("the end of the query was not reported")

    def late_rows(self, query: StreamingQuery) -> int:
        """Rows that came behind the watermark so far, of all batches."""
        with self._changed:
            return sum(r[5] for r in self._records.values() if r[0] == str(query.runId))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a batch."""
        with self._changed:
            rows = sorted(self._records.values(), key=lambda r: (r[0], r[2]))
        return spark.createDataFrame(rows, PROGRESS)


def watched(spark: SparkSession) -> ProgressLog:
    """A log of the streams that are started from now on; ``spark.streams.removeListener`` ends it."""
    log = ProgressLog()
    spark.streams.addListener(log)
    return log

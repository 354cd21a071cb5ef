"""A primary-key table in buckets of the key, of which a flush rewrites only those its changes touch.

A batch of changes is first kept beside the table. Once enough rows or bytes are kept, or the oldest has waited
long enough, a flush reads the touched buckets, takes the last change of each key, and writes these buckets under a new
version. A manifest per batch says which version of each bucket is live and what is kept: it is written last, so
readers see a flush whole or not at all, and a batch that is replayed overwrites what it wrote before. Reading the
table is a scan: every key stands once, so nothing is shuffled.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewright.functions.ordered import latest_per_key

_MANIFEST = "kind string, number bigint, version bigint, n_rows bigint, n_bytes bigint, since double"


@dataclass
class Flush:
    """When kept changes go into the table: any bound that is reached; with none, every batch is flushed."""

    rows: int | None = None
    bytes: int | None = None
    seconds: float | None = None

    def due(self, rows: int, size: int, waited: float) -> bool:
        bounds = [(self.rows, rows), (self.bytes, size), (self.seconds, waited)]
        given = [(bound, value) for bound, value in bounds if bound is not None]
        return not given or any(value >= bound for bound, value in given)


@dataclass
class State:
    """Live version by bucket, and the batches kept with their rows, bytes and arrival."""

    buckets: dict[int, int] = field(default_factory=dict)
    kept: dict[int, tuple[int, int, float]] = field(default_factory=dict)


@dataclass
class BucketedTable:
    """``keys`` and ``order`` as for any upsert; ``n`` buckets, fixed for the life of the table. Changes have an ``op``."""

    spark: SparkSession
    target: str
    keys: list[str]
    order: list[str]
    n: int = 64
    flush: Flush = field(default_factory=Flush)

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _numbers(self, folder: str, prefix: str = "", finished: bool = False) -> list[int]:
        """Numbers of the writes in a folder, or of the finished ones."""
        files, place = self._files(folder)
        if not files.exists(place):
            return []
        names = [f.getPath().getName() for f in files.listStatus(place)]
        numbers = sorted(int(name.removeprefix(prefix)) for name in names if name.startswith(prefix) and name.removeprefix(prefix).isdigit())
        return [k for k in numbers if not finished or files.exists(self._files(f"{folder}/{prefix}{k}/_SUCCESS")[1])]

    def _manifests(self) -> list[int]:
        return self._numbers(f"{self.target}/manifest", finished=True)

    def state(self, before: int | None = None) -> State:
        """What the last finished manifest says, or the last one of an earlier batch."""
        numbers = [k for k in self._manifests() if before is None or k < before]
        found = State()
        if numbers:
            for row in self.spark.read.schema(_MANIFEST).parquet(f"{self.target}/manifest/{numbers[-1]}").collect():
                if row.kind == "bucket":
                    found.buckets[row.number] = row.version
                else:
                    found.kept[row.number] = (row.n_rows, row.n_bytes, row.since)
        return found

    def _write_state(self, batch_id: int, state: State) -> None:
        rows = [("bucket", b, v, None, None, None) for b, v in sorted(state.buckets.items())]
        rows += [("kept", k, None, *facts) for k, facts in sorted(state.kept.items())]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.target}/manifest/{batch_id}")

    def _kept(self, numbers) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.target}/kept/{k}" for k in sorted(numbers)])

    def _live(self, state: State, buckets) -> DataFrame | None:
        paths = [f"{self.target}/version={state.buckets[b]}/bucket={b}" for b in sorted(buckets) if b in state.buckets]
        return self.spark.read.option("basePath", self.target).parquet(*paths).drop("version") if paths else None

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def near(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """The flushed rows, as of before a batch, of the buckets that its keys touch; deletions are among them."""
        touched = [r[0] for r in batch.select(self._bucket()).distinct().collect()]
        rows = self._live(self.state(before=batch_id), touched)
        return None if rows is None else rows.drop("bucket")

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """Keep a batch's last change per key; flush what is kept if it is due."""
        state, path = self.state(before=batch_id), f"{self.target}/kept/{batch_id}"
        latest_per_key(batch, self.keys, self.order).withColumn("bucket", self._bucket()).write.mode("overwrite").parquet(path)
        files, place = self._files(path)
        n, size = self.spark.read.parquet(path).count(), files.getContentSummary(place).getLength()
        if n:
            state.kept[batch_id] = (n, size, time.time())
        rows, total, oldest = (f([k[i] for k in state.kept.values()] or [0]) for i, f in enumerate((sum, sum, min)))
        if state.kept and self.flush.due(rows, total, time.time() - oldest):
            self._merge(state, batch_id)
        self._write_state(batch_id, state)
        self._tidy(batch_id)

    def _merge(self, state: State, version: int) -> None:
        new = self._kept(state.kept)
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        old = self._live(state, touched)
        rows = new if old is None else new.unionByName(old)
        # Dealt by bucket once; the last change of a key is then found without another exchange.
        last = latest_per_key(rows.repartition("bucket"), ["bucket", *self.keys], self.order)
        last.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.target}/version={version}")
        state.buckets.update(dict.fromkeys(touched, version))
        state.kept.clear()

    def flush_now(self) -> None:
        """Flush what is kept, whatever the bounds say; for the end of a stream, while none runs."""
        numbers = self._manifests()
        state = self.state()
        if state.kept:
            self._merge(state, numbers[-1])
            self._write_state(numbers[-1], state)

    def _tidy(self, batch_id: int) -> None:
        """Remove what neither this manifest nor the one before it names; a running reader may have the latter."""
        manifests = [k for k in self._manifests() if k <= batch_id]
        named = [self.state(before=k + 1) for k in manifests[-2:]]
        live, kept = {v for s in named for v in s.buckets.values()}, {k for s in named for k in s.kept}
        gone = [f"{self.target}/version={v}" for v in self._numbers(self.target, "version=") if v < batch_id and v not in live]
        gone += [f"{self.target}/kept/{k}" for k in self._numbers(f"{self.target}/kept") if k < batch_id - 1 and k not in kept]
        gone += [f"{self.target}/manifest/{k}" for k in manifests[:-2]]
        for path in gone:
            files, place = self._files(path)
            files.delete(place, True)

    def current_rows(self) -> DataFrame | None:
        """The live rows as of the last flush, without a shuffle; deleted keys are gone. None before the first flush.

        Deletions stay in the buckets, so that a change that comes late still loses.
        """
        state = self.state()
        rows = self._live(state, state.buckets)
        return None if rows is None else rows.filter(F.col("op") != "delete").drop("bucket")


def start_bucketed(changes: DataFrame, table: BucketedTable, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Ingest every ``interval`` (such as ``5 seconds``), or once over what is there."""
    writer = changes.writeStream.foreachBatch(table.take).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

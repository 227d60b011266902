"""Several sinks of one stream, each given every micro-batch once, across restarts.

A micro-batch is evaluated once and staged under its number. Each sink then writes from the stage and leaves a
record when it is done. After a stop, Spark runs the last batch again under the same number: sinks with a record are
passed over, the others write from the same staged rows. A sink that can replace what it wrote for a number (a
folder per batch) thus holds each row once even if it was stopped in the middle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

Sink = Callable[[DataFrame, int], None]


def _place(spark: SparkSession, path: str):
    """A path and its file system, whichever kind the cluster uses."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _place(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _place(spark, path)
    files.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    files, at = _place(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def mark(spark: SparkSession, path: str) -> None:
    """Leave an empty record; a name appears whole or not at all."""
    files, at = _place(spark, path)
    files.mkdirs(at.getParent())
    files.create(at, True).close()


class BatchLog:
    """The staged batches and the records of who is done with them, in a folder all executors share."""

    def __init__(self, path: str, keep: int = 2):
        self.path, self.keep = path.rstrip("/"), keep

    def record(self, batch: int, sink: str) -> str:
        return f"{self.path}/done/batch={batch}/{sink}"

    def done(self, spark: SparkSession, batch: int, sink: str) -> bool:
        return exists(spark, self.record(batch, sink))

    def staged(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows of a batch, from the stage if they are there whole."""
        spark, path = rows.sparkSession, f"{self.path}/staged/batch={batch}"
        if not self.done(spark, batch, "_staged"):
            rows.write.mode("overwrite").parquet(path)
            mark(spark, self.record(batch, "_staged"))
        return spark.read.schema(rows.schema).parquet(path)

    def forget(self, spark: SparkSession, batch: int) -> None:
        """Drop a stage that no restart can ask for."""
        if batch >= 0:
            remove(spark, f"{self.path}/staged/batch={batch}")


def deliver(sinks: dict[str, Sink], log: BatchLog) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives a batch to every sink that has no record of it."""

    def handle(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if all(log.done(spark, batch, name) for name in sinks):
            return
        staged = log.staged(rows, batch)
        for name, write in sinks.items():
            if not log.done(spark, batch, name):
                write(staged, batch)
                mark(spark, log.record(batch, name))
        log.forget(spark, batch - log.keep)

    return handle


def topic_folder(path: str, topic: str) -> Sink:
    """JSON lines of one topic, a folder per batch, which a second try replaces."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.where(F.col("topic") == topic).drop("topic").write.mode("overwrite").json(f"{path}/batch={batch}")

    return write


def read_topic(spark: SparkSession, path: str, log: BatchLog, name: str) -> DataFrame:
    """key and value of all batches that the sink is done with; what a stopped one has left is not read."""
    files, at = _place(spark, path)
    found = [str(f.getPath().getName()) for f in files.listStatus(at)] if files.exists(at) else []
    whole = [f"{path}/{n}" for n in found if n.startswith("batch=") and log.done(spark, int(n[6:]), name)]
    schema = "key string, value string"
    return spark.read.schema(schema).json(whole) if whole else spark.createDataFrame([], schema)


def start(rows: DataFrame, sinks: dict[str, Sink], log: BatchLog, checkpoint: str,
          every: str | None = None) -> StreamingQuery:
    """Run the stream into all sinks, at intervals or until everything available is processed."""
    writer = rows.writeStream.foreachBatch(deliver(sinks, log)).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()

"""The same operators on streams.

`detect_all`, `scan`, `anonymize` and `reveal` are stateless in-row expressions and take a
streaming DataFrame as it is (with a map small enough for the pattern strategy; larger
ones go through `anonymize_stream`).  What needs state is here.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmap.operators.findings import approve, scan, unique_identifiers
from veilmap.operators.generate import generate_map
from veilmap.operators.replace import Replacer, anonymize
from veilmap.schemas import MAP
from veilmap.sources.storage import new_path


def new_identifiers(findings: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """The first sight of each identifier; one seen again within `delay` is dropped and the
    state of older ones is released."""
    return findings.withWatermark(time, delay).dropDuplicatesWithinWatermark(
        ["identifier_type", "value"])


def type_counts_by_window(findings: DataFrame, time: str, length: str = "1 hour",
                          delay: str = "1 hour") -> DataFrame:
    """Findings per type and tumbling event-time window."""
    return (findings.withWatermark(time, delay)
            .groupBy(F.window(time, length).alias("w"), "identifier_type")
            .agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), "identifier_type", "n"))


class _BatchFolders:
    """Tables of a foreachBatch sink, one folder per kind and micro-batch.  A batch repeated after a failure
    reads earlier folders alone and writes its own again."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _part(self, batch: int, kind: str = "batch") -> str:
        return f"{self.folder}/{kind}={batch:012d}"

    def _numbers(self, spark, kind: str) -> list[int]:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}=*/_SUCCESS")
        found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])

    def _delete(self, spark, paths) -> None:
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class ClosedWindows(_BatchFolders):
    """foreachBatch sink that counts rows per tumbling event-time window and the columns `by`.

    The mark of a batch is the greatest time of all earlier batches less `delay`.  Rows of windows that
    end no later than the mark, and rows without a time, are written aside as they are (`late`).  Windows that the
    next mark has passed are final and written once (`closed`); only the open ones, at most as
    many as fit between the mark and the greatest time, are carried on as a small table of counts.
    """

    def __init__(self, folder: str, time: str, by=(), length: str = "1 hour", delay: str = "1 hour"):
        super().__init__(folder)
        self.time, self.by, self.length, self.delay = time, list(by), length, delay

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [n for n in self._numbers(spark, "high") if n < batch_id]
        high = spark.read.parquet(self._part(earlier[-1], "high")).first()["high"] if earlier else None
        delay = F.expr(f"interval {self.delay}")
        batch = batch.persist()
        try:
            highest = batch.agg(F.max(self.time)).first()[0]
            highest = max((t for t in (high, highest) if t is not None), default=None)
            mark, end = F.lit(high).cast("timestamp") - delay, F.col("_window.end")
            # Only `time` decides the window; other columns keep their names.
            rows = batch.withColumn("_window", F.window(F.coalesce(self.time, F.lit(0).cast("timestamp")), self.length))
            late = F.col(self.time).isNull() | F.coalesce(end <= mark, F.lit(False))
            rows.where(late).drop("_window").write.mode("overwrite").parquet(self._part(batch_id, "late"))
            counts = rows.where(~late).groupBy(F.col("_window.start").alias("window_start"), *self.by).agg(
                F.count("*").alias("n"))
            if earlier:
                counts = counts.unionByName(spark.read.schema(counts.schema).parquet(self._part(earlier[-1], "open")))
            total = counts.groupBy("window_start", *self.by).agg(F.sum("n").alias("n")).persist()
            final = F.coalesce(F.col("window_start") + F.expr(f"interval {self.length}")
                               <= F.lit(highest).cast("timestamp") - delay, F.lit(False))
            total.where(final).write.mode("overwrite").parquet(self._part(batch_id, "closed"))
            total.where(~final).write.mode("overwrite").parquet(self._part(batch_id, "open"))
            total.unpersist()
        finally:
            batch.unpersist()
        spark.createDataFrame([(highest,)], "high timestamp").write.mode("overwrite").parquet(self._part(batch_id, "high"))
        # A batch is repeated only while it is the last one, so the two newest tables suffice.
        self._delete(spark, [self._part(n, kind) for kind in ("open", "high") for n in earlier[:-1]])

    def _all(self, spark, kind: str) -> DataFrame:
        return spark.read.parquet(*[self._part(n, kind) for n in self._numbers(spark, kind)])

    def closed(self, spark) -> DataFrame:
        """(window_start, by, n): the final windows so far."""
        return self._all(spark, "closed")

    def late(self, spark) -> DataFrame:
        """The rows that came too late or have no time, with all their columns."""
        return self._all(spark, "late")


class MapGrowth(_BatchFolders):
    """foreachBatch sink that adds the new identifiers of each micro-batch to a stored map.

    A batch writes only its own entries, into a folder named after it.
    Every `SNAPSHOT` batches the map so far is written as one table, and what an earlier
    snapshot holds is deleted, so the cost of a batch does not grow with the number of batches.
    """

    SNAPSHOT = 20

    def __init__(self, folder: str, key, text: str, approved=None, **rules):
        super().__init__(folder)
        self.key, self.text = key, text
        self.approved, self.rules = approved, rules

    def current(self, spark, before: int | None = None, rewriting: bool = False) -> DataFrame:
        """The map of all complete batches, or of those before a batch; `rewriting` leaves out the
        snapshot made at that very batch."""
        held = [n for n in self._numbers(spark, "snapshot")
                if before is None or n < before or (n == before and not rewriting)]
        start = held[-1] if held else 0
        parts = [self._part(start, "snapshot")] if held else []
        parts += [self._part(n) for n in self._numbers(spark, "batch") if n >= start and (before is None or n < before)]
        return spark.read.schema(MAP).parquet(*parts) if parts else spark.createDataFrame([], MAP)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.grow(batch, batch_id)

    def grow(self, batch: DataFrame, batch_id: int) -> None:
        found = unique_identifiers(scan(batch, self.key, self.text), self.key)
        found = found if self.approved is None else approve(found, self.approved)
        known = self.current(batch.sparkSession, batch_id)
        generate_map(found, known, **self.rules).write.mode("overwrite").parquet(self._part(batch_id))
        if (batch_id + 1) % self.SNAPSHOT == 0:
            self._snapshot(batch.sparkSession, batch_id + 1)

    def _snapshot(self, spark, upto: int) -> None:
        earlier = [n for n in self._numbers(spark, "snapshot") if n < upto]
        self.current(spark, upto, rewriting=True).write.mode("overwrite").parquet(self._part(upto, "snapshot"))
        if not earlier:
            return
        # A batch is repeated only while it is the last one, so the snapshot before this one suffices.
        old = [self._part(n) for n in self._numbers(spark, "batch") if n < earlier[-1]]
        self._delete(spark, old + [self._part(n, "snapshot") for n in earlier[:-1]])


class GrowingAnonymizer(MapGrowth):
    """foreachBatch sink that first adds a micro-batch's identifiers to the map and then writes
    the batch anonymised with it: nothing first seen after the start stays in clear."""

    def __init__(self, folder: str, key, text: str, out: str, approved=None, **rules):
        super().__init__(folder, key, text, approved, **rules)
        self.out = out.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.grow(batch, batch_id)
        m = self.current(batch.sparkSession, batch_id + 1)
        anonymize(batch, m, self.text).write.mode("overwrite").parquet(f"{self.out}/batch={batch_id:012d}")


def anonymize_stream(stream: DataFrame, m: DataFrame, text: str, out: str, state: str, **options) -> None:
    """Writes all available input below `out`, anonymised with a map of any size: each micro-batch is
    replaced as a table, by the strategy that fits the map, which is read once."""
    replace = Replacer(m, **options)

    def write(batch: DataFrame, batch_id: int) -> None:
        replace(batch, text).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id:012d}")

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", state)
     .trigger(availableNow=True).start().awaitTermination())


def run_available(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Process all available input once into a table and return it."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    (stream.writeStream.format("parquet").outputMode(output_mode)
     .option("path", out).option("checkpointLocation", new_path(spark, f"{name}-state"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(out)

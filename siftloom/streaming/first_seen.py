"""First-seen answers on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import hashing
from siftloom.operators import bloom


class SeenFilter:
    """A bit filter that grows with each micro-batch: the batch is answered against it, then its bits are added.

    The bits are tables in the shared folder: one directory a batch, and every `every` batches a base that holds all bits so far,
    so that a batch reads a base and a few batches however long the stream runs. What lies before the base before the last is
    removed. A batch that is run again writes its own directory again and is answered without it and without any base that
    holds it, so a restart changes no answer; a batch without a directory, such as a skipped one, had no bits."""

    def __init__(self, path: str, m: int, h: int, family: str = hashing.DEFAULT, every: int = 16):
        self.path, self.m, self.h, self.family, self.every = path.rstrip("/"), m, h, family, every

    def _folder(self, spark: SparkSession):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _kept(self, spark: SparkSession) -> tuple[list[int], list[int]]:
        """Numbers of the complete bases and batches, in order."""
        fs, path = self._folder(spark)
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return tuple(sorted(int(n.split("=")[1]) for n in names if n.startswith(kind) and done(n)) for kind in ("base=", "batch="))

    def bits(self, spark: SparkSession, before: int) -> DataFrame:
        bases, batches = self._kept(spark)
        base = max((b for b in bases if b < before), default=-1)
        read = [f"{self.path}/base={base}"] * (base >= 0) + [f"{self.path}/batch={i}" for i in batches if base < i < before]
        return spark.read.schema("pos bigint").parquet(*read).distinct() if read else spark.createDataFrame([], "pos bigint")

    def take(self, batch: DataFrame, number: int, element: str, order: list[str]) -> DataFrame:
        """(order, element, present) of the batch; within it the earlier rows count."""
        spark = batch.sparkSession
        out = bloom.insert_and_check(batch, element, order, self.m, self.h, self.family, self.bits(spark, number))
        bloom.build(batch, element, self.m, self.h, family=self.family).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        return out

    def compact(self, spark: SparkSession, number: int) -> None:
        """Writes a base after batch `number` if one is due, and removes what no batch from here on can want."""
        bases, batches = self._kept(spark)
        last = max((b for b in bases if b <= number), default=-1)
        if number - last < self.every:
            return
        self.bits(spark, number + 1).write.mode("overwrite").parquet(f"{self.path}/base={number}")
        fs, _ = self._folder(spark)
        old = [f"base={b}" for b in bases if b < last] + [f"batch={i}" for i in batches if i <= last]
        for name in old:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def sink(self, element: str, order: list[str], emit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch; batches are numbered upwards, as Spark does."""

        def take(batch: DataFrame, number: int) -> None:
            emit(self.take(batch, number, element, order), number)
            self.compact(batch.sparkSession, number)

        return take


def deduplicated(stream: DataFrame, element: str, event_time: str, delay: str) -> DataFrame:
    """The exact form within a watermark, by Spark's own state store."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([element])

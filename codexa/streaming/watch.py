"""A watched server's progress as a stream source, and entries that expire as stream state.

``WatchSource`` reads numbered pages that a server has written (Parquet, by any file
system that Arrow knows).  Its offset is the number of the last page and the newest
update up to it; a batch takes ``pages_per_batch`` pages at most, however far behind
the reader is.  A page is one partition, so a lost executor reads its page again.

``expiring`` keeps the newest entry of each key until its time is over.  Time is the
events' own: entries are compared by their stamps, and timers drop what no later row
can ask for once the watermark has passed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

PAGE = re.compile(r"page-(\d{9})\.parquet$")
PAGES_PER_BATCH = 4
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _system(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def _files(path: str):
    """The file system of a path, and its pages by number."""
    from pyarrow import fs

    system, root = _system(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return system, {int(m[1]): f.path for f in found if (m := PAGE.search(f.path)) and f.is_file}


def _micros(column: pa.Array) -> pa.Array:
    """Instants to the microsecond, as Spark has them."""
    return column.cast(pa.timestamp("us", "UTC"), safe=False) if pa.types.is_timestamp(column.type) else column


class PagePart(InputPartition):
    def __init__(self, number: int, file: str):
        self.number, self.file = number, file


class WatchReader(DataSourceStreamReader):
    """Pages in order of their numbers; a page that comes late is read when all before it are there."""

    def __init__(self, schema: T.StructType, options: dict):
        self.fields, self.path, self.stamp = [f.name for f in schema.fields], options["path"], options.get("stamp", "ts")
        self.most, self.catch_up = int(options.get("pages_per_batch", PAGES_PER_BATCH)), int(options.get("catch_up", 0))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"page": 0, "updated": ""}

    def latestOffset(self) -> dict:
        start = self.at or self.initialOffset()
        system, pages = _files(self.path)
        number, newest = start["page"], start["updated"]
        most = max(self.most, min(start["page"], self.catch_up))
        while number - start["page"] < most and number + 1 in pages:
            number += 1
        with ThreadPoolExecutor(8) as pool:
            newest = max([newest, *pool.map(lambda n: self._newest(system, pages[n]), range(start["page"] + 1, number + 1))])
        self.at = {"page": number, "updated": newest}
        return self.at

    def _newest(self, system, file: str) -> str:
        """From the footer's statistics, so that the page isn't read on the driver."""
        import pyarrow.parquet as pq

        with system.open_input_file(file) as f:
            meta = pq.ParquetFile(f).metadata
        column = next((i for i in range(meta.num_columns) if meta.schema.column(i).name == self.stamp), None)
        found = [s.max for g in range(meta.num_row_groups) if column is not None and (s := meta.row_group(g).column(column).statistics) and s.has_min_max]
        return max((x.isoformat() if hasattr(x, "isoformat") else str(x) for x in found), default="")

    def partitions(self, start: dict, end: dict) -> list[PagePart]:
        # After a new start, batches go on behind those that the checkpoint names.
        if self.at is None or self.at["page"] < end["page"]:
            self.at = dict(end)
        pages = _files(self.path)[1]
        return [PagePart(n, pages[n]) for n in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: PagePart) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        with _system(self.path)[0].open_input_file(partition.file) as f:
            for b in pq.ParquetFile(f).iter_batches(columns=self.fields):
                yield pa.RecordBatch.from_arrays([_micros(b.column(n)) for n in self.fields], names=self.fields)

    def commit(self, end: dict) -> None:
        pass


class WatchSource(DataSource):
    """``spark.readStream.format("watch").schema(...).load(folder)``; options: path, stamp, pages_per_batch, catch_up."""

    @classmethod
    def name(cls) -> str:
        return "watch"

    def schema(self):
        raise ValueError("a watched server needs a schema")

    def streamReader(self, schema: T.StructType) -> WatchReader:
        return WatchReader(schema, self.options)


def watch(spark: SparkSession, folder: str, schema: T.StructType, stamp: str, pages_per_batch: int = PAGES_PER_BATCH, catch_up: int = 0) -> DataFrame:
    spark.dataSource.register(WatchSource)
    return spark.readStream.format("watch").schema(schema).option("stamp", stamp).option("pages_per_batch", pages_per_batch).option("catch_up", catch_up).load(folder)


def write_pages(rows: DataFrame, folder: str, order: list[str], per_page: int, first: int = 1) -> int:
    """Writes rows as a server's pages, in order; the number of the next page.

    A page is the rows of one range, about ``per_page`` of them; files get their page's
    number in a job's own folder and then move, so a page is there whole or not at all.
    """
    spark = rows.sparkSession
    n = max(1, -(-rows.count() // per_page))
    staged = f"{folder}/_staged-{first}"
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path(staged)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in system.listStatus(path) if f.getPath().getName().startswith("part-"))
    for i, name in enumerate(names):
        system.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{staged}/{name}"), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/page-{first + i:09d}.parquet"))
    system.delete(path, True)
    return first + len(names)


def drain(writer: DataStreamWriter) -> None:
    """Runs a stream batch by batch until its source has no more."""
    q = writer.start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


class Expiring(StatefulProcessor):
    """The newest entry of a key: set by entries, read by requests, gone after its time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "stamp long, expires long, response string")

    def handleInputRows(self, key, rows, timerValues):
        # A micro-batch's rows of a key, by their own time; those of one time set before they ask.
        # The state is read once and written once, however many rows there are.
        before = held = tuple(self.entry.get()) if self.entry.exists() else None
        for r in sorted(rows, key=lambda r: (r["stamp"], r["asks"], r["ord"])):
            if held is not None and held[1] is not None and r["stamp"] > held[1]:
                held = None
            if r["asks"]:
                answered = held is not None and held[0] <= r["stamp"]
                yield T.Row(key=key[0], ord=r["ord"], stamp=r["stamp"], hit=answered, response=held[2] if answered else None)
            elif held is None or r["stamp"] >= held[0]:
                held = (r["stamp"], None if r["ttl"] is None else r["stamp"] + r["ttl"], r["response"])
        if held is None and before is not None:
            self.entry.clear()
        elif held is not None and held != before:
            self.entry.update(held)
            if held[1] is not None:
                self.handle.registerTimer(-(-held[1] // 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.entry.get() if self.entry.exists() else None
        if held is not None and held[1] is not None and -(-held[1] // 1000) + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


ANSWERS = "key string, ord long, stamp long, hit boolean, response string"


def expiring(rows: DataFrame, late: str = "1 minute") -> DataFrame:
    """Requests of a stream of (key, ord, at, stamp, asks, ttl, response), with what the cache answers.

    ``at`` is the event time, ``stamp`` and ``ttl`` are in microseconds; an entry answers until
    its stamp plus ttl, that instant included, or always without a ttl.  Rows come in order
    of time, up to ``late``; what is older than the watermark isn't answered.
    """
    return rows.withWatermark("at", late).groupBy("key").transformWithState(Expiring(), ANSWERS, "Append", "EventTime")


def answered(rows: DataFrame) -> DataFrame:
    """The same of a table at once: each request's newest entry up to its time, if it hasn't expired."""
    from pyspark.sql import Window

    before = Window.partitionBy("key").orderBy("stamp", "asks", "ord").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.last(F.when(~F.col("asks"), F.struct("stamp", "ttl", "response")), ignorenulls=True).over(before)
    told = rows.withColumn("entry", entry).filter("asks")
    hit = F.coalesce(F.col("entry").isNotNull() & (F.col("entry.ttl").isNull() | (F.col("stamp") <= F.col("entry.stamp") + F.col("entry.ttl"))), F.lit(False))
    return told.select("key", "ord", "stamp", hit.alias("hit"), F.when(hit, F.col("entry.response")).alias("response"))


def run_expiring(rows: DataFrame, place: str) -> DataFrame:
    """Runs such a stream until its source has no more; all of its answers.

    Every micro-batch writes its answers under its number, so one that runs again writes the same again.
    """
    spark = rows.sparkSession
    # A batch starts a worker and a store for each partition of the state: as many as there are cores, not as shuffles have.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, spark.sparkContext.defaultParallelism))
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(parts)}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        drain(expiring(rows).writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{place}/answers/batch={n}")).option("checkpointLocation", f"{place}/checkpoint"))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(ANSWERS).parquet(f"{place}/answers/batch=*")

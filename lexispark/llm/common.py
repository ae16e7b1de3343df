"""What the operators share: the shared folder, staged tables, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.splits import read_spread

#: Spark's setting to delete shuffle files at the end of an execution.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the rows of an Arrow batch. It closes a batch at 64 MB in any case.
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows and bytes that an operator is given at once. Tasks cut the batches that Spark sends, so no operator depends on the session's settings.
TEXT_BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; only Spark opens the path. Tables whose rows are much work are dealt over all cores."""
    path = f"{sf_dir}/{name}.parquet"
    return read_spread(spark, path) if name in ("documents", "pages", "embeddings") else spark.read.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine alone may do without; it gets a folder that goes at exit."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    held = spark.conf.get("lexispark.shared.dir", None)
    if not held:
        folder = tempfile.mkdtemp(prefix="lexispark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        held = "file://" + folder
        spark.conf.set("lexispark.shared.dir", held)
    return held


@contextlib.contextmanager
def running(spark: SparkSession, rows: int = 0, **more: str) -> Iterator[None]:
    """Settings of what is run within: small Arrow batches, so that the JVM holds little as well. The session has its own again after that."""
    wanted = {BATCH_SETTING: str(rows or TEXT_BATCH_ROWS), **more}
    given = spark.conf.getAll
    held = {k: given.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def collected(df: DataFrame, rows: int = 0) -> list:
    """The rows of a small result, its plan run with batches of so many rows."""
    with running(df.sparkSession, rows):
        return df.collect()


#: Open scopes, innermost last; each lists the tables staged within it.
_scopes: list[list[Staged]] = []


@contextlib.contextmanager
def staging() -> Iterator[None]:
    """Tables staged within are dropped at the end: what reads them must be written by then."""
    own: list[Staged] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for table in own:
            table.drop()


class Staged:
    """A DataFrame written as Parquet into the shared folder; later stages read it and lineage ends there.

    It goes when `drop` is called, or with the scope it is made in (`staging`). One that a returned frame still reads is left to the
    end of the session, whose file system deletes it.
    """

    def __init__(self, df: DataFrame, label: str, rows: int = 0):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        if _scopes:
            _scopes[-1].append(self)
        with running(self.spark, rows, **{SHUFFLE_CLEANUP: "true"}):  # the table takes the place of the shuffle files that made it
            df.write.parquet(self.path)
        system, path = self._file()
        system.deleteOnExit(path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self.df._lexispark_staged = self

    @classmethod
    def of(cls, df: DataFrame, label: str) -> Staged:
        """The table that df reads, where df is that of a staged table as it is; a new one otherwise."""
        return df.__dict__.get("_lexispark_staged") or cls(df, label)

    def _file(self):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def keep(self) -> None:
        """Leaves the table where its scope ends."""
        for own in _scopes:
            if self in own:
                own.remove(self)

    def drop(self) -> None:
        """Removes the files, once nothing reads them any more."""
        system, path = self._file()
        system.delete(path, True)
        system.cancelDeleteOnExit(path)


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once a context, where it isn't installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_lexispark_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="lexispark-code-")) / "lexispark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    sc.addPyFile(str(archive))
    sc._lexispark_shipped = True


def slices(batch: pa.RecordBatch, rows: int, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts, without copying, of so many rows and bytes at most; a longer row is a part of its own."""
    if batch.num_rows > rows:
        for k in range(0, batch.num_rows, rows):
            yield from slices(batch.slice(k, rows), rows, size)
    elif batch.num_rows > 1 and batch.nbytes > size:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), rows, size)
        yield from slices(batch.slice(half), rows, size)
    else:
        yield batch


def arrow_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str | StructType, batch_rows: int = TEXT_BATCH_ROWS) -> DataFrame:
    """mapInArrow over df. make() is called once a task and returns a function from a batch to a dict of columns.

    Batches have batch_rows rows and BATCH_BYTES bytes at most, whatever the session's settings are when the plan runs; a longer row
    comes alone. If the function has an attribute `finish`, it is called after the last batch and returns such a dict too.
    """
    ship(df.sparkSession)
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        table = lambda out: pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, out[f.name]) for f in arrow)], schema=arrow)
        for whole in batches:
            for batch in slices(whole, batch_rows):
                out = step(batch)
                if out is not None:
                    yield table(out)
        out = step.finish() if hasattr(step, "finish") else None
        if out is not None:
            yield table(out)
        del step, out
        give_back()

    return df.mapInArrow(run, target)


def give_back() -> None:
    """Hands freed memory back to the system: workers live on from task to task and stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library isn't glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def count_of(df: DataFrame) -> int:
    return collected(df.agg(F.count(F.lit(1))))[0][0]


#: Ids that may be broadcast (16 bytes each at most); more are joined by a shuffle.
SMALL_IDS = 2_000_000


def without_ids(docs: DataFrame, ids: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """docs without the rows of these ids; rows with a null id stay. The ids are counted: few enough are broadcast, so texts aren't shuffled."""
    gone = Staged(ids.select(key).where(F.col(key).isNotNull()).distinct(), label).df
    return docs.join(F.broadcast(gone) if count_of(gone) <= SMALL_IDS else gone, key, "left_anti").select(*docs.columns)


#: Parts of one key that a task adds up, about.
SUMMED = 64


def total_of(parts: DataFrame, dtype: str, tasks: int = 8) -> dict[int, np.ndarray]:
    """Sums equally long arrays by key: parts has key long and data binary. Tasks add up what they receive one by one, so each holds a sum a key.

    Keys and lengths must not depend on the number of rows; the sums come to the driver.
    """

    def make():
        sums: dict[int, np.ndarray] = {}

        def step(batch):
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(data.as_buffer(), dtype=dtype)
                if key in sums:
                    sums[key] += x
                else:
                    sums[key] = x.copy()

        step.finish = lambda: {"key": list(sums), "data": [x.tobytes() for x in sums.values()]} if sums else None
        return step

    add = lambda df, n, *by: arrow_rows(df.repartition(n, *by).select("key", "data"), make, "key long, data binary", batch_rows=64)
    given = parts.rdd.getNumPartitions()
    if given > SUMMED:  # sums of sums: no task reads more than so many parts of a key
        salts = -(-given // SUMMED)
        parts = add(parts.withColumn("_salt", F.spark_partition_id() % salts), min(4096, tasks * salts), "key", "_salt")
    rows = collected(add(parts, tasks, "key"), 64)
    return {r["key"]: np.frombuffer(r["data"], dtype=dtype) for r in rows}


#: Rows that one task numbers at once, about, in gapless ranks.
RANKED_ROWS = 125_000


def gapless(df: DataFrame, by: str, order: list[str], rows: int, name: str) -> DataFrame:
    """df with a number from 0, without gaps, among the rows of each value of `by`.

    Values are split by a salt from the ordering columns, so that a value that a third of all rows have is
    numbered by many tasks: counts by (value, salt) give each salt's first number, a row number within it the rest.
    The ordering columns must tell rows apart (repeated rows by a stored number), or equal rows are one task's work.
    """
    salts = max(4, min(100_000, rows // RANKED_ROWS + 4))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy(by, "_salt").agg(F.count("*").alias("_n")).select(by, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(by, "_salt").orderBy(*order)
    return salted.withColumn("_rn", F.row_number().over(within)).join(first, [by, "_salt"]).withColumn(name, F.col("_first") + F.col("_rn") - 1).drop("_salt", "_rn", "_first")

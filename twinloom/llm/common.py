"""Helpers that the operators share: inputs, written intermediates, ranks, batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinloom.shared import shared_dir

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Scratch folders by tag, so that a pipeline can drop those of an earlier stage.
_SCRATCH: dict[str, list[str]] = {}
_TAG = ["query"]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that they need no installation."""
    sc = spark.sparkContext
    if getattr(sc, "_twinloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    name = f"{tempfile.mkdtemp(prefix='twinloom-')}/twinloom.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(name)
    sc._twinloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read by Spark only (the folder may be in any store)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage is cut and lost executors cost nothing.

    most: a bound on its rows, where one is known; a small table then gets few files.
    """
    if most is not None:
        df = df.coalesce(max(1, -(-most // ROWS_A_FILE)))
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder in the shared one for a table of this name, that does not exist yet; noted under the current tag."""
    ship(spark)
    path = f"{shared_dir(spark)}/twinloom/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(_TAG[0], []).append(path)
    return path


#: Rows of a small table that share a file.
ROWS_A_FILE = 20_000


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that nothing refers to any more; they would stay until the driver's next collection."""
    gc.collect()
    spark._jvm.System.gc()


def tag_scratch(spark: SparkSession, tag: str, drop: bool = False) -> None:
    """From now on written() files its tables under tag; with drop, all that tag's tables so far are deleted first."""
    for path in _SCRATCH.pop(tag, []) if drop else []:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _TAG[0] = tag


def sized(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A written table, marked for broadcast if it has few enough rows (of some 24 bytes each); else it is shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ..., which no operator's own names clash with, and the new name of each old one."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), {c: f"c{i}" for i, c in enumerate(df.columns)}


def n_words(text: Column) -> Column:
    """Number of words of a text as long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*cols: Column) -> Column:
    """A seeded hash as a double in [0, 1): 52 bits of xxhash64."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") / F.lit(float(1 << 52))


def ranked(df: DataFrame, keys: list[str], u: str, tie: list[str], rank: str, per: int = 256) -> DataFrame:
    """df with ``rank`` (0, 1, ...) in the order of column u, then tie, within the groups of keys.

    No group is sorted by one task: a group of n rows is cut by u into about
    n / per parts, their sizes are summed up first, and only rows of one part
    meet in a window. Null keys form groups like any other value.
    """
    def on(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
        b = b.select(*[F.col(k).alias(f"_r_{k}") for k in names], *[c for c in b.columns if c not in names])
        test = None
        for k in names:
            one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
            test = one if test is None else test & one
        return a.join(b, test, "inner").drop(*[f"_r_{k}" for k in names])

    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(per)).alias("_parts"))
    cut = on(df, sizes, keys).withColumn("_part", F.least(F.floor(F.col(u) * F.col("_parts")), F.col("_parts") - 1)).drop("_parts")
    parts = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_part").orderBy(u, *tie)
    return on(cut, parts, [*keys, "_part"]).withColumn(rank, F.col("_before") + F.row_number().over(inside) - 1).drop("_part", "_before")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow of a function from one batch to columns (name -> list or array) of the schema's order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return in_arrow(df, run, schema)


#: Rows and bytes that a Python worker is handed at once, unless the session sets others than Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1500, 8 << 20


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers give their memory back at the end of a partition (Spark keeps the idle processes)."""
    spark = df.sparkSession
    ship(spark)
    for key, usual, own in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", own)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return df.mapInArrow(tidy, schema)


def trim() -> None:
    """Returns freed memory of this process to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def as_array(values, kind: pa.DataType) -> pa.Array:
    """values (list, numpy array or Arrow array) as an Arrow array of the kind."""
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)

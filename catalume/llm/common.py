"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset (tests on one machine), a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='catalume-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/catalume/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The file system of a path and the path as it wants it, by Spark's own connectors."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def until_exit(spark: SparkSession, path: str) -> str:
    """Has the folder ``path`` deleted when the driver's JVM ends."""
    fs, there = file_system(spark, path)
    fs.deleteOnExit(there)
    return path


#: Session setting under which a query's shuffle files go when the query ends, not when the driver's JVM next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: it cuts the lineage, and a lost executor loses nothing. The folder goes when the driver ends, or earlier by `discard`. From then on the session's queries, the lazy result's too, leave no shuffle files behind."""
    df.sparkSession.conf.set(CLEANUP, "true")
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(until_exit(df.sparkSession, path))


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` made and that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            fs, there = file_system(df.sparkSession, folder)
            fs.delete(there, True)


#: Rows of an Arrow batch for long texts, so that a worker's memory doesn't follow the usual 10,000.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows or fewer. The setting stays: it is read when a lazy result is run, long after the operator's call, and every Python operator of this package wants it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def pack(df: DataFrame, *columns: str, **more: Column) -> DataFrame:
    """The named columns of ``df`` (all, if none are named) as the struct `row`, and columns of its own beside it: names that operators use inside can't meet names of the data."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in columns or df.columns)).alias("row"), *(c.alias(k) for k, c in more.items()))


#: Parts that the rows of one key are dealt to in `join_spread`.
SALTS = 256


def join_spread(rows: DataFrame, told: DataFrame, key: str, salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``told``, which has one row a key and reaches each of them, however many share a key: a key's rows are dealt by ``salt`` (a hash of whatever tells them apart) to SALTS tasks. ``told`` is repeated for the salts that a key has, no more than SALTS times nor than the key has rows."""
    salted = rows.withColumn("__salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    each = salted.select(key, "__salt").distinct().join(told, key)
    return salted.join(each, [key, "__salt"], how).drop("__salt")


#: Rows of a table that are sent to all tasks, some 20 MB for narrow ones; larger tables are joined by a shuffle.
SENT_ROWS = 200_000


def join_told(rows: DataFrame, told: DataFrame, key: str, salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``told`` (written, narrow, one row a key): sent to all tasks if it has up to SENT_ROWS rows, else by `join_spread`. Rows without a key there go, or stay with ``how`` left."""
    return rows.join(F.broadcast(told), key, how) if told.count() <= SENT_ROWS else join_spread(rows, told, key, salt, how)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once for a row, however often and in whatever lambda ``body`` uses it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column, block: int = 256) -> Column:
    """For each element of an array what ``combine`` (associative, with ``zero`` as its neutral element) makes of all elements before it.

    Blocks of ``block`` elements are combined on their own and then with what stands before them, since an array that is
    built element by element is copied each time: the work grows little faster than the array.
    """
    none = F.slice(F.array(zero), 1, 0)
    start = F.struct(zero.alias("at"), none.alias("out"))

    def scan(xs: Column, value: Callable[[Column], Column]) -> Column:
        step = lambda a, x: F.struct(combine(a["at"], value(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(xs, start, step)

    def blocks(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: scan(F.slice(xs, b * block + 1, block), lambda x: x))

    def joined(parts: Column) -> Column:
        before = scan(parts, lambda p: p["at"])["out"]
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p["out"], lambda x: combine(b, x))))

    return let(let(values, blocks), joined)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Separator of the words `[^\x20\x09-\x0D]+`, for Java's regular expressions.
SPACES = r"[ \t-\r]+"


def space_words(text: Column) -> Column:
    """The array of words `[^\\x20\\x09-\\x0D]+` of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")

"""What the operators of this subpackage share: the shared folder, written tables, ordered ranks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The white space of every word rule here: space and the five ASCII controls 9 to 13.
WS = " \t\n\x0b\x0c\r"
#: The same as a Java or Python character class.
WS_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a folder of this machine serves, which only a local master can
    use; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="sediment-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_roots: dict[str, str] = {}
#: The tables that each owner's last call wrote, and the lists that are being filled.
_owned: dict[tuple[str, str], list[str]] = {}
_filling: list[list[str]] = []


@contextlib.contextmanager
def owned(spark: SparkSession, owner: str) -> Iterator[None]:
    """Tables written inside belong to ``owner``; those of its call before are removed first."""
    key = (spark.sparkContext.applicationId, owner)
    for path in _owned.pop(key, []):
        _remove(spark, path)
    _filling.append([])
    try:
        yield
    finally:
        _owned[key] = _filling.pop()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; all of an application's go when it ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_dir(spark)}/sediment-{app}"

        def clean() -> None:
            try:
                _remove(spark, _roots[app])
            except Exception:  # the session has ended already; the folder's owner cleans it
                pass

        atexit.register(clean)
    path = f"{_roots[app]}/{name}-{uuid.uuid4().hex[:12]}"
    for paths in _filling:
        paths.append(path)
    return path


#: Where each table of ``written`` lies, as long as its frame is held.
_written_at: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Rows of a table of short rows that one file should hold at least.
FILE_ROWS = 100_000


def written(df: DataFrame, name: str, *, partition_by: str | None = None, path: str | None = None, rows: int | None = None, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts the lineage and outlives any executor.

    ``rows`` is a bound on the number of its rows, if known and the rows are short: then there are
    no more files, and tasks that write them, than it needs.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    writer = df.write.option("compression", "zstd").options(**options)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written_at[out] = path
    return out


def drop_written(df: DataFrame) -> None:
    """Frees the files of a table of ``written`` that nothing reads any more; ``df`` must be what that returned."""
    _remove(df.sparkSession, _written_at.pop(df))


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_room(df: DataFrame, used: list[str], results: list[str]) -> DataFrame:
    """``df`` without extra columns whose names an operator needs for its results or its own columns."""
    taken = {r.lower() for r in results}
    return df.select(*[named(c) for c in df.columns if c in used or not (c.startswith("__") or c.lower() in taken)])


#: What an Arrow batch on its way to Python may hold, so that neither side ever has many long texts at once.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def _returned(func: Callable) -> Callable:
    """``func``, which at its end gives the memory that it no longer uses back: workers are kept for other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from func(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def in_arrow(df: DataFrame, func: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes: the session's limits are lowered to the ones here, never raised."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b"))
        if not 0 < now <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df.mapInArrow(_returned(func), schema)


def map_beside(df: DataFrame, text: str, carried: list[str], func: Callable, added: list[T.StructField]) -> DataFrame:
    """``df``'s ``carried`` columns and those that ``func`` adds to Arrow batches of (text, row).

    ``func`` returns batches of (row, *added). The carried columns travel as one struct, whose
    fields may have any name.
    """
    row = F.struct(F.lit(0).alias("__"), *[named(c) for c in carried]).alias("__row")
    shaped = df.select(named(text).alias("__text"), row)
    out = in_arrow(shaped, func, T.StructType([shaped.schema["__row"], *added]))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in carried], *[f.name for f in added])


BROADCAST_ROWS = 50_000


def beside_all(df: DataFrame, name: str) -> DataFrame:
    """A table of one short row for each group, to be joined to all rows.

    It is written and counted: up to BROADCAST_ROWS rows it is sent to the executors, so that the
    rows it is joined to stay where they are; beyond, the join is left to shuffle.
    """
    table = written(df, name)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


SALT_ROWS = 4096


def join_spread(df: DataFrame, on: str, small: DataFrame, key: str, n: str, by: Column, total: int, *, hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``df`` joined to ``small``, which has each ``key`` once, and in ``n`` how many rows of ``df`` have it.

    A key with more than ``limit`` rows is dealt by ``by`` to as many salts as it has limits. The
    keys that are salted are sent to the executors: with ``total`` rows in ``df`` there are fewer
    than 40,000 of them, whatever the total. They are read from ``hot`` (key, n), or from ``small``. Null keys meet nothing
    and are dealt anywhere. ``small`` is never sent as a whole: its size in files, by which Spark would
    judge, is that of compressed columns.
    """
    limit = max(SALT_ROWS, total // 40_000)
    salts = F.greatest(F.ceil(F.col(n) / limit), F.lit(1)).cast("int")
    hot = (small if hot is None else hot).where(F.col(n) > limit).select(F.col(key).alias("__hk"), salts.alias("__hs"))
    left = df.join(F.broadcast(hot), F.col(on) == F.col("__hk"), "left")
    left = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__hs", F.when(F.col(on).isNull(), 1 << 10), F.lit(1))).cast("int")).drop("__hk", "__hs")
    right = small.withColumn("__part", F.explode(F.sequence(F.lit(0), salts - 1))).hint("merge")
    return left.join(right, (F.col(on) == F.col(key)) & (F.col("__salt") == F.col("__part")), how).drop("__salt", "__part")


def beside_groups(df: DataFrame, on: str, groups: DataFrame, key: str, n: str, by: Column, total: int, name: str) -> DataFrame:
    """``df`` left-joined to a table of one short row for each group, by a key that is never null.

    As ``beside_all``, but beyond BROADCAST_ROWS groups those with many of ``df``'s ``total`` rows, as ``n`` counts
    them, are salted by ``by``.
    """
    table = written(groups, name)
    if table.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), F.col(on) == F.col(key), "left")
    return join_spread(df, on, table, key, n, by, total, how="left")


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters that are not white space; a null has none."""
    bare = F.btrim(text, F.lit(WS))
    return F.when(bare.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, WS_CLASS + "+"))).cast("long")


def seeded(seed: int | str, *cols: Column) -> Column:
    """60 uniform bits of a row from md5, the same on every run, engine and partitioning."""
    parts = [F.lit(str(seed))] + [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def row_hash(df: DataFrame) -> Column:
    """A hash of all the row's columns that Spark can hash: it deals rows of one key that are not wholly equal."""
    plain = [named(f.name) for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and not f.name.startswith("__")]
    return F.xxhash64(F.lit(0), *plain)


def ordered_index(df: DataFrame, keys: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``: the row's position from 0 within ``keys``, in the order of ``bucket``, then ``order``.

    ``bucket`` must follow the order. Rows are sorted within a bucket only; the buckets' counts,
    a small table, give each one its first position. So a key of any size is spread over as
    many tasks as it has buckets.
    """
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = upto.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("__b"),
        F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__first"),
    )
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    on = F.col(bucket).eqNullSafe(F.col("__b"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    ranked = df.withColumn("__i", F.row_number().over(within) - 1)
    return (
        ranked.join(first, on, "left")
        .withColumn(out, (F.col("__first") + F.col("__i")).cast("long"))
        .drop("__b", "__first", "__i", *[f"__k{i}" for i in range(len(keys))])
    )


RUN_ROWS = 100_000


def running(df: DataFrame, order: list[Column], value: Column, out: str, rows: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before a row in ``order``, however large the table.

    The rows are laid in files by ranges of the order, where equal rows are dealt apart, and each
    file's sum, one row for RUN_ROWS of them, gives the next its start. ``rows`` is their number.
    """
    deal = F.xxhash64(F.monotonically_increasing_id())
    laid = df.withColumn("__deal", deal).repartitionByRange(max(1, -(-rows // RUN_ROWS)), *order, F.col("__deal")).sortWithinPartitions(*order, "__deal").drop("__deal")
    laid = written(laid.withColumn("__at", F.monotonically_increasing_id()), "laid").withColumn("__file", F.shiftright("__at", 33))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy("__file").agg(F.sum(value).alias("__sum"))
    starts = sums.select(F.col("__file").alias("__of"), F.coalesce(F.sum("__sum").over(upto(F.lit(0)).orderBy("__file")), F.lit(0)).alias("__start")).hint("merge")
    inside = F.coalesce(F.sum(value).over(upto("__file").orderBy("__at")), F.lit(0))
    both = laid.withColumn("__in", inside).join(starts, F.col("__file") == F.col("__of"))
    return both.withColumn(out, F.col("__start") + F.col("__in")).drop("__at", "__file", "__of", "__start", "__in")


def root_buckets(n: int) -> int:
    """About the square root of ``n``: then buckets and the rows in each grow alike."""
    return max(1, math.isqrt(max(n, 1)))

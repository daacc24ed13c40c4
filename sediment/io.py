"""Tables that a plan reads more than once, written in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local master without one gets a folder of this machine."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="sediment-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_roots: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the application ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _roots:
        root = _roots[sc.applicationId] = f"{shared_dir(spark)}/sediment-tables-{sc.applicationId}"

        def clean() -> None:
            with contextlib.suppress(Exception):  # the session may have ended already; the folder's owner cleans it then
                p = sc._jvm.org.apache.hadoop.fs.Path(root)
                p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

        atexit.register(clean)
    return f"{_roots[sc.applicationId]}/{name}-{uuid.uuid4().hex[:12]}"


class Versions:
    """A stored table that is replaced as a whole: readers see one version or the next, never a part.

    Each version is a numbered folder, and the current one is the last that Spark's committer has
    marked as complete, so a writer that fails leaves the version before in place. Older versions
    stay for those who still read them, until ``prune``. There may be one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The complete versions, in order."""
        found = self._fs.globStatus(self._path(f"{self.path}/v-*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName()[2:]) for f in found or [])

    def read(self, number: int | None = None) -> DataFrame:
        number = self.numbers()[-1] if number is None else number
        return self.spark.read.parquet(f"{self.path}/v-{number:09d}")

    def swap(self, df: DataFrame) -> DataFrame:
        """Writes ``df``, which may read the version before, as the next version."""
        number = max(self.numbers(), default=0) + 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/v-{number:09d}")
        return self.read(number)

    def prune(self, keep: int = 1) -> None:
        for number in self.numbers()[:-keep]:
            self._fs.delete(self._path(f"{self.path}/v-{number:09d}"), True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: they go when it is there, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Where each table of ``written`` lies, as long as its frame is held.
_written_at: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own: computed once, read as often as the plan needs it."""
    path = scratch(df.sparkSession, name)
    with freeing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written_at[out] = path
    return out


def _located(df: DataFrame):
    """The file system and path of a table of ``written``."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(_written_at[df])
    return path.getFileSystem(sc._jsc.hadoopConfiguration()), path


def size_of(df: DataFrame) -> int:
    """Bytes in the files of a table of ``written``."""
    fs, path = _located(df)
    return fs.getContentSummary(path).getLength()


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables of ``written`` that nothing reads any more."""
    for df in tables:
        fs, path = _located(df)
        fs.delete(path, True)


#: So many short rows at most are sent to the executors, so that what they are joined to stays where it is.
SENT_ROWS = 500_000


def beside(df: DataFrame) -> DataFrame:
    """A written table of short rows, to be joined to long ones: sent if it has few, else left to the planner."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df

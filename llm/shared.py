"""Tables in the folder that all machines of the cluster share, and connected components over them."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Tables that stand in the shared folder now, and their sessions.
_LIVE: dict[str, SparkSession] = {}


def named(column: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all machines of the cluster see.

    Where the session names none and Spark runs on this machine alone, as in
    tests, one of its own until the driver ends; on a cluster an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder; intermediate tables need one that all machines share")
    if not hasattr(context, "_llm_folder"):
        context._llm_folder = tempfile.mkdtemp(prefix="llm-shared-")
        atexit.register(shutil.rmtree, context._llm_folder, ignore_errors=True)
    return f"file://{context._llm_folder}"


def shipped(spark: SparkSession) -> None:
    """Sends this subpackage to the Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="llm-code-")) / "llm_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(here.glob("*.py")):
            z.write(f, f"llm/{f.name}")
    context.addPyFile(str(to))
    context._llm_shipped = True


def small_batches(spark: SparkSession) -> None:
    """For applications, not called by any operator: Arrow batches of 4 MB, where the session has Spark's default of 64 MB.

    Texts may be long, and two buffers and two workers a core hold a batch each.
    """
    if spark.conf.get(ARROW_BYTES) == "67108864b":
        spark.conf.set(ARROW_BYTES, "4194304b")


def stashed(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table written in the shared folder.

    This cuts the lineage: a lost executor costs its tasks, never the stages
    before the table. The table goes with scratch() or dropped(), or at last
    when the driver ends, as lazy results may read it until then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stash-{uuid.uuid4().hex}"
    if not _LIVE:
        atexit.register(_cleared)
    _LIVE[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def _deleted(path: str) -> None:
    spark = _LIVE.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _cleared() -> None:
    for path in list(_LIVE):
        with contextlib.suppress(Exception):  # the context may have ended before
            _deleted(path)


def dropped(df: DataFrame) -> None:
    """Deletes the table of a stashed() frame that nothing reads any more."""
    _deleted(getattr(df, "_stash", ""))


@contextlib.contextmanager
def scratch(kept: list[DataFrame]) -> Iterator[None]:
    """Deletes, at its end, the tables stashed within it, but for those of the frames in kept by then."""
    before = set(_LIVE)
    yield
    spared = {getattr(df, "_stash", None) for df in kept}
    for path in [x for x in _LIVE if x not in before and x not in spared]:
        _deleted(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node reachable.

    Large-star and small-star rounds (Kiveris et al., 2014): each node's
    neighbours are tied to the least of them until every component is a star.
    Nothing but two sums per round reaches the driver.
    """

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stashed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = summary(edges)
    while last[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        new = stashed(small)
        now = summary(new)
        dropped(edges)
        edges, done = new, now == last
        last = now
        if done:
            break
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(edges.select("b", "b").distinct())

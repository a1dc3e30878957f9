"""Shared helpers: tables, lineage cuts in the shared folder, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a cluster it must be set, a temporary one is made in local mode only, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='shared-')}")
    return folder


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets Arrow batches hold at most ``most`` bytes, so that Python workers stay small whatever the length of the texts."""
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a frame of ``written`` that nothing needs any more."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for path in [p for p in _WRITTEN if any(f.endswith(p.rpartition("/")[2]) for f in folders)]:
        remove(spark, path)


@contextmanager
def scratch(spark: SparkSession, keep: Callable[[], list[DataFrame]] = list) -> Iterator[None]:
    """Deletes on leaving what ``written`` wrote inside, but for the frames that ``keep`` names then."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        kept = {f.rpartition("/")[0].rpartition("/")[2] for df in keep() for f in df.inputFiles()}
        for path in [p for p in _WRITTEN if p not in before and p.rpartition("/")[2] not in kept]:
            remove(spark, path)


def apart(df: DataFrame, *taken: str) -> dict[str, str]:
    """The columns of ``df`` by the names they leave an operator with that adds the columns ``taken``: a column
    of one of these names, in whatever case, leaves as input_<name>."""
    out, used = {}, {c.lower() for c in df.columns} | {t.lower() for t in taken}
    for c in df.columns:
        name = c
        while name.lower() in {t.lower() for t in taken} or (name != c and name.lower() in used):
            name = f"input_{name}"
        used.add(name.lower())
        out[c] = name
    return out


def own(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no name of theirs meets a working column."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_own")


def released(names: dict[str, str]) -> list[Column]:
    """The columns of ``own`` by the names of ``apart``."""
    return [F.col("_own").getField(c).alias(n) for c, n in names.items()]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for the undirected edges (a, b); root is the smallest node of the component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until
    the edge set is stable.  Each step groups by node with ``min`` (combined before
    the shuffle) and joins back, and every round is written to the shared folder.
    """
    e = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        root = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(root, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")).select("p.a", "p.b").where("a <> b").distinct()
        new = written(small, "edges")
        ends = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        same = new.agg(ends.alias("s")).collect() == e.agg(ends.alias("s")).collect()
        drop_written(e)
        e = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

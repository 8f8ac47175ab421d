"""Session helpers: checkpoint folder, connected components, bucketed prefix sums, code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


#: Bytes of an Arrow batch: what a worker and its task hold of long texts at once.
ARROW_BYTES = "8m"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application), and bound the bytes
    of an Arrow batch where the session has Spark's default for them."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's checkpoint folder. Only a local session without one gets one of our
    own: executors on other machines would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spool(df: DataFrame) -> DataFrame:
    """Cut lineage like ``checkpoint``, in compressed columns in the same folder: for tables of many rows
    of which each reader takes some columns, and for small ones whose size the planner shall know."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/spool-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*jobs) -> list:
    """The results of functions without arguments that run their Spark jobs at the same time."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _forest(batches):
    """Replace the links of a partition by stars to the smallest id (bounded pieces)."""
    import pyarrow as pa

    limit = 200_000
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars():
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        parent.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["a", "b"]
        )

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > limit:
            yield stars()
    if parent:
        yield stars()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over the links, for every id that has one.

    Links are first contracted inside each partition, then alternating large-star and
    small-star rounds run with a reliable checkpoint each. A round emits at most two rows
    per link, so no group is expanded into pairs. Nulls and self-links count for nothing.
    """
    spark = links.sparkSession
    ship_package(spark)
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = checkpoint(edges.mapInArrow(_forest, "a long, b long").where("a > b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        # large star: every larger neighbour of u points to u's smallest neighbour (or u)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        # small star: u and its smaller neighbours point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        )
        new = checkpoint(small)
        same = new.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(new, ["a", "b"], "left_anti").isEmpty()
        edges = new
        if same:
            break
    else:
        raise RuntimeError("connected components did not converge")
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value, out: str, buckets: int = 512, deal=None) -> DataFrame:
    """Exclusive running sum of ``value`` inside each group, without one task per group.

    Rows of a group are dealt over ``buckets`` by a hash of the order columns (or by ``deal``, a
    number from 0 to ``buckets``); the bounded
    table of bucket sums (groups x buckets rows) is scanned by a window, and the rows are
    numbered inside their bucket. The order inside a group is (bucket, order columns): fixed
    by the rows alone, so reruns agree. Null group values form one group of their own.
    """
    keyed = df.withColumn("_b", (F.pmod(F.xxhash64(*order), F.lit(buckets)) if deal is None else deal).cast("int")).withColumn("_v", value.cast("long"))
    sums = keyed.groupBy(*group, "_b").agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_gb"),
                       F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    cond = F.col("_b") == F.col("_gb")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        local.join(base, cond)
        .withColumn(out, (F.col("_base") + F.col("_in")).cast("long"))
        .drop("_b", "_v", "_gb", "_base", "_in", *[f"_g{i}" for i in range(len(group))])
    )

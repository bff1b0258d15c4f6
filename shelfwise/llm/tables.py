"""Lineage cuts, global row numbers and connected components on DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCOPE: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: `spark.checkpoint.dir` of the session.

    Only where that is unset on a single machine (tests) a folder of our own is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return str(known.get()).rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="shelfwise-")
    spark.sparkContext.setCheckpointDir(own)
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


class Scratch:
    """Tables stashed inside a `with` block are deleted at its end, but for those kept.

    Kept ones belong to the block around, if there is one: what a query returns may still be
    read from them.
    """

    def __enter__(self) -> Scratch:
        self.frames: list[DataFrame] = []
        self.outer = _SCOPE.get()
        self.token = _SCOPE.set(self)
        return self

    def keep(self, *frames: DataFrame) -> None:
        paths = {getattr(f, "_stash_path", None) for f in frames}
        for f in [f for f in self.frames if f._stash_path in paths]:
            self.frames.remove(f)
            if self.outer is not None:
                self.outer.frames.append(f)

    def __exit__(self, *_) -> None:
        _SCOPE.reset(self.token)
        release(*self.frames)


def stash(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    Later stages read replicated files instead of shuffle output of executors that may
    be gone, and the plan starts anew from a scan.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    if (scope := _SCOPE.get()) is not None:
        scope.frames.append(out)
    return out


def release(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like `wanted` that clash with no column of `df`, whatever its case."""
    return free_names(df.columns, *wanted)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """The top-level column of exactly this name: dots and backticks are part of it."""
    return F.col("`" + column.replace("`", "``") + "`")


def others(df: DataFrame, text_col: str, *results: str) -> list[str]:
    """Columns to carry beside a text: all but it and those named like a result."""
    taken = {text_col.lower(), *(r.lower() for r in results)}
    return [c for c in df.columns if c.lower() not in taken]


def text_rows(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """The columns `carry` as c0, c1, ..., and as the last one, `text`, the text as a string.

    Functions over Arrow batches take their columns by place: Spark does not take all names.
    """
    return docs.select(*safe(carry), named(text_col).cast("string").alias("text"))


def safe(carry: list[str]) -> list[Column]:
    return [named(c).alias(f"c{i}") for i, c in enumerate(carry)]


def shape_of(docs: DataFrame, carry: list[str], more: dict[str, str]) -> T.StructType:
    """The schema of the columns `carry` and of further ones: type by name, whatever the names."""
    further = [T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in more.items()]
    return T.StructType([docs.schema[c] for c in carry] + further)


def ranges_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_row_numbers(df: DataFrame, name: str, order: list[Column]) -> tuple[DataFrame, int]:
    """(df with the gapless global row number, number of rows). Column `name` is long, from 0, in the given order; stashed.

    Rows are range-partitioned and sorted; each partition's start is a sum over the row
    counts of the partitions before it, so no task sees more than its range. The ranges
    are written before they are counted, hence both passes see the same ones. Rows equal
    in all of `order` may swap numbers.
    """
    mark, part, start, size = fresh(df, "mark", "part", "start", "size")
    ranged = stash(
        df.repartitionByRange(ranges_for(df.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumn(mark, F.monotonically_increasing_id())
    ).withColumn(part, F.shiftright(mark, 33))
    # one row a partition: as many as spark.sql.shuffle.partitions
    sizes = ranged.groupBy(part).agg(F.count("*").alias(size))
    before = F.sum(size).over(Window.orderBy(part))
    starts = stash(sizes.select(part, (before - F.col(size)).alias(start), F.col(size)))
    total = starts.agg(F.sum(size)).head()[0] or 0
    within = F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(starts.drop(size)), part).withColumn(name, F.col(start) + within).drop(mark, part, start), total


def _contract(batches):
    """A partition's edges as stars: each node with the least node it reaches in here."""
    up: dict = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in up if root(x) != x]
    for lo in range(0, len(nodes), 100_000):
        part = nodes[lo : lo + 100_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges(u, v)` (long): rows (node, component = least node).

    Alternating large-star and small-star rounds: each round is two minimum aggregations
    and two equi-joins, whatever the degree of a node, and lineage is cut after each.
    Before a round every partition turns its own edges into stars, which makes long chains
    short; its memory is bounded by the partition's edges. Nodes' labels only ever fall, so
    the rounds end; their number grows with the logarithm of the longest chain.
    """

    def contracted(df: DataFrame) -> DataFrame:
        return df.select("u", "v").mapInArrow(_contract, "u long, v long")

    now = stash(contracted(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))

    def state(df: DataFrame):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        return r[0], r[1]

    seen = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        with Scratch() as own:
            merged = stash(small.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
            after = stash(contracted(merged).distinct())
            own.keep(after)
        release(now)
        now, before = after, seen
        seen = state(now)
        if seen == before:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)

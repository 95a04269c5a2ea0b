"""What the operators share: the shared folder, cut lineage, byte views of Arrow strings."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Where it is unset, a local session (tests) gets one of its own; a cluster gets an error, for its executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="orbweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/orbweave-{name}-{uuid.uuid4().hex}"


class _Made(threading.local):
    """Folders that this thread's operators have stored tables in, oldest first, and the tables that they hold."""

    def __init__(self):
        self.paths: list[str] = []
        self.frames: list[DataFrame] = []


_MADE = _Made()
FEW = 2


def condensed(df: DataFrame, name: str) -> DataFrame:
    """stored() for what a shuffle has made much smaller than its input: several partitions go to one file, so that many partitions don't make many tiny files. Tasks still take one partition after another, and there are FEW times as many tasks as cores."""
    return stored(df.coalesce(FEW * df.sparkSession.sparkContext.defaultParallelism), name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _MADE.paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def held(df: DataFrame) -> DataFrame:
    """df kept on the executors' disks for several uses within an operator, with its lineage: what a lost executor held is computed again. For large tables that an operator reads right after making them; nothing that it returns may read them, for tidy() lets go of them."""
    _MADE.frames.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def _folder(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of stored tables, once nothing reads them again."""
    for df in tables:
        fs, path = _folder(df.sparkSession, df.stored_at)
        fs.delete(path, True)
        if df.stored_at in _MADE.paths:
            _MADE.paths.remove(df.stored_at)


class tidy:
    """with tidy(spark) as keep: on leaving, the tables stored since are deleted, but for those given to keep(), which the result still reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self):
        self.first, self.frames = set(_MADE.paths), len(_MADE.frames)
        return self.keep

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df.stored_at)
        return df

    def __exit__(self, *_):
        for df in _MADE.frames[self.frames :]:
            df.unpersist()
        del _MADE.frames[self.frames :]
        for p in [p for p in _MADE.paths if p not in self.first and p not in self.kept]:
            fs, path = _folder(self.spark, p)
            fs.delete(path, True)
            _MADE.paths.remove(p)


def clear_stored(spark: SparkSession) -> None:
    """Lets go of all held tables and deletes all tables that this thread's operators have stored; results that weren't written yet can't be read any more."""
    for df in _MADE.frames:
        df.unpersist()
    _MADE.frames.clear()
    for p in list(_MADE.paths):
        fs, path = _folder(spark, p)
        fs.delete(path, True)
    _MADE.paths.clear()


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a table's bytes, from its files' sizes; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def free_names(taken, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of taken has it, whatever the case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *outputs: str) -> list[str]:
    """The columns of df but those that an output replaces, whatever the case."""
    gone = {c.lower() for c in outputs}
    return [c for c in df.columns if c.lower() not in gone]


def fields_of(df: DataFrame, columns) -> str:
    """The schema of some columns as DDL, ending in a comma."""
    return "".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def col(name: str) -> Column:
    """A column by its plain name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(c: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def small_batches(spark: SparkSession) -> SparkSession:
    """Texts go to Python in Arrow batches of 500 rows or 1 MB at most: memory of executor and worker then follows neither rows nor long texts, but for one text."""
    for key, most in (("maxRecordsPerBatch", 500), ("maxBytesPerBatch", 1 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or int(now) not in range(1, most + 1):
            spark.conf.set(key, str(most))
    return spark


def trim() -> None:
    """At the end of a task: hands freed memory back to the system, since the worker goes on to other tasks or waits for them."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if give_back:
        give_back(0)


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_view(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array, and the offsets (one more than rows) of each row in them; null is empty."""
    strings = strings.cast(pa.large_string())
    if strings.null_count:
        strings = strings.fill_null("")
    _, offsets, data = strings.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


BROADCAST_BYTES = 48 << 20
_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8}


def _width(c: str, kind) -> str:
    """SQL: the bytes of a value, about as Spark's rows hold it."""
    name = kind.typeName()
    if name in ("string", "binary"):
        return f"coalesce(octet_length({c}), 0) + 16"
    if name == "array":
        inner = kind.elementType
        if inner.typeName() in ("string", "binary", "array", "struct"):
            return f"aggregate(coalesce({c}, array()), 16L, (s, x) -> s + {_width('x', inner)})"
        return f"greatest(size({c}), 0) * {_WIDTH.get(inner.simpleString(), 16)}L + 16"
    if name == "struct":
        return "8 + " + " + ".join(f"({_width(f'{c}.`{f.name}`', f.dataType)})" for f in kind)
    return str(_WIDTH.get(kind.simpleString(), 16))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, or a selection of one, for the right side of a join: broadcast if its files (where it is a stored table) and then its rows, as they are in memory, have at most so many bytes; else as it is, and the join shuffles."""
    at = getattr(df, "stored_at", None)
    if at:
        fs, path = _folder(df.sparkSession, at)
        if fs.getContentSummary(path).getLength() > most:
            return df
    each = " + ".join(f"({_width(f'`{f.name}`', f.dataType)})" for f in df.schema)
    return F.broadcast(df) if (df.agg(F.sum(F.expr(f"CAST(16 + {each} AS bigint)"))).first()[0] or 0) <= most else df


def without(docs: DataFrame, ids: DataFrame, doc_id: str) -> DataFrame:
    """The rows of docs whose id is not in ids, a stored table of one column; null ids stay."""
    (name,) = free_names(docs.columns, "gone")
    return docs.join(small(ids).toDF(name), col(doc_id) == F.col(name), "left_anti")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least one that it is connected with, without those to itself."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    half = len(a)
    for x, y in zip(ends[:half].tolist(), ends[half:].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array(parent, np.int64)
    while len(root) and (root != (up := root[root])).any():
        root = up
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def forests(batches):
    """Replaces the edges of a run of batches by a spanning forest of them."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def out():
        a, b = forest(*(np.concatenate(x) for x in zip(*kept)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        kept.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        n += batch.num_rows
        if n > 200_000:
            yield out()
            kept, n = [], 0
    if kept:
        yield out()
    kept.clear()
    trim()


def thinned(run):
    """run, a function of batches that yields edges, with forests() in the same worker: as two steps of mapInArrow, a task would hold two workers at once, and an executor keeps as many as it ever had."""
    return lambda batches: forests(run(batches))


STEPS = 59


def components(edges: DataFrame, name: str, thin: bool = True) -> DataFrame:
    """(node, root) for each node of edges (a, b: long): root is the least node connected with it.

    Alternating large-star and small-star steps over the edges, each step's edges stored in the shared folder
    until they stay the same; an error if STEPS steps don't settle them. With thin, tasks first replace their edges by spanning forests, so hubs
    shrink before they are shuffled; without, what made the edges has done so. Nothing but a count and a checksum reaches the driver.
    """
    def kept(df: DataFrame, step: int) -> tuple[DataFrame, tuple]:
        df = condensed(df, f"{name}-{step}")
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = edges.select("a", "b").filter("a <> b")
    current, mark = kept((edges.mapInArrow(forests, "a long, b long") if thin else edges).distinct(), 0)
    for step in range(1, STEPS + 1):
        if not mark[0]:
            break
        both = current.union(current.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).filter("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        other = large.join(low.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following, new = kept(low.select("a", F.col("m").alias("b")).union(other).distinct(), step)
        dropped(current)
        current, same, mark = following, new == mark, new
        if same:
            break
    else:
        raise RuntimeError(f"components of {name} have not settled in {STEPS} steps")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b"), F.col("b")).distinct())


#: Odd multipliers for hashes.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
BASE = 0x5851F42D4C957F2D
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * ODD[0])
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers from 0 to n."""
    if len(_POWERS[0]) <= n:
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


class Prints:
    """64-bit fingerprints of any range of some bytes: polynomials over a random value for each byte."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * ODD[1])

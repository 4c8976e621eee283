"""What several operators share: the shared folder, cut lineage, held-out folds."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []
_written: list[str] = []
_recorder: ContextVar[list[str] | None] = ContextVar("recorder", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset a temporary folder stands in, on a local master only: elsewhere executors wouldn't
    find it, and an error is raised.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="quillstream-"))
    return _own_folder[0]


def stored(df: DataFrame, label: str, files: int = 0) -> tuple[DataFrame, str]:
    """df, written once as Parquet in the shared folder and read back (lineage ends there), and its path.

    files: into how many it is dealt first, where its size is known; else one for each partition.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.repartition(files) if files else df).write.parquet(path)
    _written.append(path)
    if (paths := _recorder.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str, files: int = 0) -> DataFrame:
    """stored(), for what a returned DataFrame reads: it stays until discard_all()."""
    return stored(df, label, files)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete what stored() has written."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written.remove(path)
    if path in (paths := _recorder.get() or []):
        paths.remove(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all that stored() writes in this context."""
    paths: list[str] = []
    token = _recorder.set(paths)
    try:
        yield paths
    finally:
        _recorder.reset(token)


def discard_all(spark: SparkSession) -> None:
    """Delete all that this process has written and not deleted yet: call it when the results are saved."""
    for path in list(_written):
        discard(spark, path)


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left.join(right), never by a broadcast: for sides without a bound.

    Spark would broadcast each side below the session's threshold, and a plan of many joins builds them all at once on the driver.
    """
    return left.join(right.hint("merge"), on, how)


def merged_to_groups(left: DataFrame, groups: DataFrame, on: str) -> DataFrame:
    """merged() with what a groupBy(on) has made. The key's hash is joined too: so both sides are exchanged anew, and
    Spark can split a frequent key's rows, which it can't where one side lies as grouped."""
    keyed = lambda df: df.withColumn("_hash", F.xxhash64(on))
    return merged(keyed(left), keyed(groups), [on, "_hash"]).drop("_hash")


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def release() -> None:
    """Give freed memory back to the system: idle Python workers share the executor with the next stage."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(f: Callable) -> Callable:
    """f, which releases memory after its first batch and every eighth from then on (it costs a fifth of a batch's time)."""
    calls = [0]

    @wraps(f)
    def run(*batch):
        try:
            return f(*batch)
        finally:
            if calls[0] % 8 == 0:
                release()
            calls[0] += 1

    return run


def fold(doc_id: Column, of: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo `of`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def long_array(values: list[int]) -> Column:
    """A constant array of longs, one literal in the plan however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")


def bounds_of(df: DataFrame, column: str, ranges: int) -> list[int]:
    """Bounds that cut the values of a long column into about equal ranges; nulls don't count."""
    found = df.agg(F.percentile_approx(column, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("b")).first().b
    return sorted(set(found or []))


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the value, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    known = long_array(bounds)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= len(bounds)) & (F.get(known, n + s - 1) <= value), n + s).otherwise(n))
    return F.when(value.isNull(), 0).otherwise(found)


def sample_ids(df: DataFrame, n: int) -> DataFrame:
    """The n distinct doc_ids with the least hashes (fewer if there are fewer); nulls don't count.

    Only ids under a hash that some 2n + 100 rows have are made distinct and sorted. Where ids repeat so often that
    these are too few ids, the hash is raised.
    """
    span = 1 << 40
    ids = df.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64("doc_id"), F.lit(span)).alias("h"))
    below = -(-span * (2 * n + 100) // max(1, ids.count()))
    while True:
        found = [r.doc_id for r in ids.where(F.col("h") < below).distinct().orderBy("h", "doc_id").limit(n).collect()]
        if len(found) >= n or below >= span:
            return small_table(df.sparkSession, {"doc_id": found}, {"doc_id": pa.int64()})
        below *= 8


def whole_text(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def row_key(df: DataFrame) -> list[Column]:
    """Two columns `_id` and `_row` that name a row by its content: doc_id (0 for null) and a hash of all columns.

    Rows that agree in both are the same row repeated (but for one pair in 2**64).
    """
    values = [F.to_json(F.struct(c)) if "map<" in t or t == "variant" else F.col(f"`{c}`") for c, t in df.dtypes]
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("_id"), F.xxhash64(*values, *(v.isNull() for v in values)).alias("_row")]


#: Settings of a session, their defaults, and the bounds that operators put in place of a default.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1500"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(4 << 20)))


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch hands to Python by bytes: texts may be very long.

    Each operator that calls Python asks for it. Its plan is made when the caller runs it, so the bounds have to stay
    in the session; what the caller has set stays as it is.
    """
    for name, default, bound in BATCHES:
        if spark.conf.get(name) == default:
            spark.conf.set(name, bound)


def small_table(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType]) -> DataFrame:
    """Lists at hand as a DataFrame. They go through Arrow: a list of rows would start Python workers on the executors."""
    return spark.createDataFrame(pa.table({c: pa.array(columns[c], t) for c, t in types.items()}))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

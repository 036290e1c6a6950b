"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_MADE: list[str] = []
#: Most keys that :func:`heavy_join` broadcasts.
HEAVY_KEYS = 100_000
#: Rows of a file of a table whose number of rows is known before it is written.
FILE_ROWS = 20_000
#: The same for a table of texts.
TEXT_ROWS = 1_000
#: Bytes of texts, about, that are sent to Python at once.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session.  Only where that is unset and driver and executors are one process (tests,
    local mode) a folder of our own; a cluster has to name one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="voxlake-")
    return _OWN[app]


def shared_table(df: DataFrame, name: str, rows: int | None = None, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.  Where it has at most
    ``rows`` small rows, it is written by as many tasks as these fill files, and not by one
    for each shuffle partition.

    This cuts the lineage with files that outlive any executor; what is written
    is also computed only once, however many plans read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` small rows that take long to make: made by all its tasks,
    and dealt to as many as these rows fill files.  On a local file system an executor
    starts a process for every file, which for a moment doubles the memory that it seems to
    take."""
    return df.repartition(max(1, -(-rows // FILE_ROWS)))


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table written by :func:`shared_table` once nothing reads it."""
    delete_path(df.sparkSession, df.shared_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the tables that :func:`shared_table` writes inside.  What is
    wanted of them must have been written elsewhere by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[before:]:
            delete_path(spark, path)
        del _MADE[before:]


def heavy_join(left: DataFrame, right: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has each key once and, as
    ``count``, the rows that ``left`` has of it; ``left`` has ``total`` rows or fewer.

    Keys of more than ``total / HEAVY_KEYS`` rows are at most ``HEAVY_KEYS``, whatever
    the data: these are broadcast, so that the rows of a key stay spread over all tasks.
    The rows of all other keys are joined by shuffle."""
    least = max(64, -(-total // HEAVY_KEYS))
    heavy = F.broadcast(right.filter(F.col(count) > least))
    light = left.join(heavy.select(*key), key, "left_anti").join(right.filter(F.col(count) <= least), key)
    return left.join(heavy, key).unionByName(light)


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only, a null text as the empty text.  Other columns,
    whatever their names, never reach an operator."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of ``BATCH_BYTES`` or one text.  Spark sends
    10,000 rows, which are 35 MB of ordinary texts, and a worker keeps room for them.

    Spark reads the setting when the plan runs, so it stays set for the session; what needs
    more rows at once collects them (:func:`regrouped`).  A smaller limit is left alone."""
    spark = df.sparkSession
    given = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < given <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of exactly ``rows``, but for the last."""
    held, n = [], 0
    for b in batches:
        while n + b.num_rows >= rows:
            held.append(b.slice(0, rows - n))
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            b, held, n = b.slice(rows - n), [], 0
        if b.num_rows:
            held.append(b)
            n += b.num_rows
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def filled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of ``size`` bytes or little more, but for the last."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            full, held, n = pa.Table.from_batches(held).combine_chunks().to_batches(), [], 0
            del b
            yield from full
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pieces(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches cut into slices of at most ``rows`` rows, to bound memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def let(value: Column, body) -> Column:
    """``body`` of a column that is computed once per row, not once per use: optimiser
    rules copy plain columns into every place that names them."""
    return F.transform(F.array(value), body)[0]

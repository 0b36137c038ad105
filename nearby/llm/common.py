"""Small shared parts: table reads, fresh column names, Arrow-batched column computation, the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearby.plans.session import shared_dir

#: Rows that a worker turns into Python objects at once.
BATCH_ROWS = 256
#: Bytes of an Arrow batch, which the executor and its worker both hold.
BYTES_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches, for whole texts travel in them. A size that the session states itself stays.

    Spark reads the setting when a frame runs, so it can't be taken back before; it changes no result.
    """
    if spark.conf.get(BYTES_SETTING, None) is None:
        spark.conf.set(BYTES_SETTING, BATCH_BYTES)


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows (none empty), so that long texts don't pile up as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that no given column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def annotate(df: DataFrame, inputs: list[str], fields: list[T.StructField], compute: Callable[..., list[pa.Array]]) -> DataFrame:
    """``df`` with columns that ``compute`` makes of the named input columns, one Arrow batch at a time.

    The new names must not be among ``df``'s; see ``fresh``.
    """
    at = [df.columns.index(c) for c in inputs]
    names = [*df.columns, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(*(batch.column(i) for i in at))], names=names)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def crc32_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``. A null id is in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's address inside the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that was made by ``new_folder``, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text_col: str, id_col: str, train: Column, most: int) -> DataFrame:
    """At most ``most`` labelled texts (text, y, order), drawn by a hash of the id.

    ``train`` is a condition on the id column. Labels other than 0 and 1 are no labels; of several
    labels of an id the largest counts, of several texts of an id the one of the least hash. So the
    sample has at most ``most`` rows, and so has the table of two integers that is broadcast to the
    scan of the texts; what a repeated id has beyond one text is dropped before the shuffle.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias(id_col)).agg(F.max(label).alias("y"))
        .where(train)
        .withColumn("order", F.xxhash64(F.col(id_col)))
        .orderBy("order", id_col).limit(most)
    )
    found = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), id_col)
    least = Window.partitionBy(id_col).orderBy(F.xxhash64("text"))
    one = found.withColumn("nth", F.row_number().over(least)).where("nth = 1")
    return one.select("order", "text", F.col("y").cast("int").alias("y"))


def sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))

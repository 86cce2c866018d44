"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_open: list[Scratch] = []
#: Largest row count that is ever sent to all executors as a join side.
BROADCAST_ROWS = 50_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_text(name: str = "text") -> Column:
    """The text column with null read as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, leaving every other code point alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_row(docs: DataFrame, *names: str) -> DataFrame:
    """(__row, names...): all columns of ``docs`` in one struct, so that none of their names meets an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *names)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine, a temporary one where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomsearch-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read back, and where it is."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: the lineage ends there.

    The file survives lost executors, and its size is known to the planner.  It
    goes with the ``Scratch`` that is open, if one is.
    """
    out, path = stored(df, name)
    if _open:
        _open[-1].paths.append(path)
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Removes a stored table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables in the shared folder that are removed together once nothing reads them.

    As a context it takes what ``materialize`` writes meanwhile; ``result`` writes
    what is read later on.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def __exit__(self, *_) -> None:
        _open.remove(self)
        self.drop()

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name)[0]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = stored(df, name)
        self.paths.append(path)
        return out

    def drop(self) -> None:
        for path in self.paths:
            discard(self.spark, path)
        self.paths = []


def shuffle_width(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows`` rows: the session's width, or more so that no task holds over ``per_task``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task), 1)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.RecordBatch]:
    """The rows of sorted ``batches`` cut where one of the columns ``names`` changes; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cut = np.zeros(b.num_rows, bool)
        for n in names:
            col = b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
            cut[1:] |= col[1:] != col[:-1]
            cut[0] |= bool(held) and held[-1].column(b.schema.get_field_index(n))[-1].as_py() != col[0]
        if cut[0]:
            yield _joined(held)
            held = []
        cut[0] = True
        at = np.flatnonzero(cut).tolist()
        for a, z in zip(at, [*at[1:], b.num_rows], strict=True):
            if a:
                yield _joined(held)
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield _joined(held)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df

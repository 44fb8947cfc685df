"""Helpers shared by the corpus operators: shared-folder tables, text batches, keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from airweave.session import shared_path

#: Bytes of text that one vectorised step handles at a time; a longer text goes alone.
STEP_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch that the corpus queries ask for: rows here hold whole texts.
BATCH, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of a session small, unless it has set their size itself.

    For the queries and the pipeline, which own their session; operators leave it
    alone and rely on Spark's own bound of bytes for a batch.
    """
    for name, own, value in (("maxRecordsPerBatch", ("10000",), BATCH), ("maxBytesPerBatch", ("67108864b", "67108864", "64MB"), BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, own[0]) in own:
            spark.conf.set(name, str(value))


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``taken`` is called so, whatever its case."""
    taken = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def digest(text: Column) -> Column:
    """SHA-256 of a text, by which equal whole texts meet."""
    return F.unhex(F.sha2(text, 256))


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread of this table and no
    recomputation of what led to it.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._airweave_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that nothing reads any more."""
    path = getattr(df, "_airweave_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def split_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of ``big``, where a few keys may hold a large part of the rows, with ``small``, which has each key once.

    Both sides are exchanged for this join alone, by the keys and their hash, even
    where ``small`` is partitioned by the keys already: only then can adaptive
    execution split a hot key's rows over several tasks.
    """
    (mark,) = unused([*big.columns, *small.columns], "_mark")
    value = F.xxhash64(*keys)
    return big.withColumn(mark, value).join(small.withColumn(mark, value).hint("merge"), [*keys, mark], how).drop(mark)


def steps(batch: pa.RecordBatch, text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` that hold about ``limit`` bytes of text each, at least one row."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = [x or 0 for x in pa.compute.binary_length(col).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 of each row's text; null as empty."""
    col = batch.column(batch.schema.get_field_index(text))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to at least ``rows`` rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def mapped(df: DataFrame, fn, schema: str | StructType, rows: int = 1) -> DataFrame:
    """``mapInArrow`` with ``fn`` from one record batch (of ``rows`` rows or more) to record batches (or dicts of columns)."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(kind)

    def run(batches):
        for batch in gathered(batches, rows):
            if batch.num_rows:
                for x in fn(batch):
                    yield pa.RecordBatch.from_pydict(x, schema=out) if isinstance(x, dict) else x

    return df.mapInArrow(run, kind)

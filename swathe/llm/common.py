"""Helpers that the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..sources.files import scratch

OUT_ROWS = 2000
OUT_BYTES = 8 << 20
#: Rows that are Python objects at once, and bytes that go to Python at once.
IN_ROWS, IN_BYTES = 256, 8 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read back, and its path: lineage ends there, so a lost executor costs no more than one task."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one when the table has such a column; names are compared without case, as Spark does."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def give_back() -> None:
    """Return what a task's caches held to the machine: a worker lives on for other tasks, and its allocators keep what is freed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
    if trim:
        trim(0)


#: The job that this Python worker served last, and the models that its tasks made.
_job: list[str] = []
_models: dict[Hashable, Any] = {}


def begin(job: str) -> None:
    """A worker outlives a stage; what it holds for another job goes before it works for this one."""
    if _job != [job]:
        _job[:] = [job]
        if _models:
            _models.clear()
            give_back()


def held_model(name: Hashable, make: Callable[[], Any]) -> Any:
    """One for each Python worker and job, so that what a task has met serves the worker's next tasks too."""
    if name not in _models:
        _models[name] = make()
    return _models[name]


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str | T.StructType) -> DataFrame:
    """Stream the named columns of each partition through ``fn`` as tuples, a bounded number of rows at a time.

    The size of a batch is a setting of the session, read when the table is computed; it stays set.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    df.sparkSession.conf.set(BATCH, str(IN_BYTES))  # the JVM and Python both hold a batch, and its buffers grow by doubling
    job = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(job)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, IN_ROWS):
                    part = batch.slice(at, IN_ROWS)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        out: list[tuple] = []
        held = 0
        for row in fn(rows()):
            out.append(row)
            held += sum(len(v) for v in row if isinstance(v, (str, bytes, list)))
            if len(out) >= OUT_ROWS or held >= OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        del out
        give_back()

    return df.select(*columns).mapInArrow(run, schema)


def map_texts(text: Column, start: Callable[[], Callable[[list], list]], returns: str) -> Column:
    """A column made of a text column alone; the row's other columns stay where they are.

    ``start`` is called once a task; what it returns turns a list of texts into a list of values, structs as dicts.
    """
    kind = to_arrow_type(T._parse_datatype_string(returns))
    job = uuid.uuid4().hex

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin(job)
        step = start()
        for batch in batches:
            parts = [pa.array(step(batch.slice(at, IN_ROWS).to_pylist()), kind) for at in range(0, len(batch), IN_ROWS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)
        del step
        give_back()

    # else the optimiser may evaluate it again for each use of its fields
    return F.arrow_udf(run, returns).asNondeterministic()(text)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names, whatever else the table carries; a null text is an empty one."""
    return docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))

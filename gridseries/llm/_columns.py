"""Helpers that put Python results beside the columns of a DataFrame."""

import ctypes
import gc
import pathlib
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts of one Arrow batch are worked on in slices of about this many bytes.
SLICE_BYTES = 2 << 20


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, lengthened until it clashes with no column of the frame."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context, as functions refer to it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    if package.is_dir():
        folder = tempfile.mkdtemp(prefix="spark-")
        context.addPyFile(
            shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
        )
    _SHIPPED.add(context.applicationId)


_TURN: list = [None, None]


def turn(name: str, forget: Callable[[], None]) -> None:
    """Say in a worker that an operator works there, and how to empty its memory.

    Workers outlive tasks and serve one operator after another; what the one
    before has remembered is given up first, so that memories do not add up.
    """
    if _TURN[0] != name:
        if _TURN[1] is not None:
            _TURN[1]()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _TURN[:] = [name, forget]


def released(work: Callable) -> Callable:
    """``work`` on a task's batches, which gives free memory back at the end.

    Workers wait for their next task; what they do not use would otherwise
    count against the executor all the while.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def with_results(
    frame: DataFrame, column: str, function: Callable, schema: str, most: int = SLICE_BYTES
) -> DataFrame:
    """Add the columns of ``schema``, which ``function`` makes from ``column``.

    ``function`` maps an Arrow array to an Arrow struct array; it gets the
    column in slices of about ``most`` bytes. Columns of the frame that have the name of
    a new one are replaced.
    """
    ship(frame.sparkSession)
    new = T.StructType.fromDDL(schema)
    names = {f.name.lower() for f in new.fields}
    kept = [f for f in frame.schema.fields if f.name.lower() not in names]
    # Under numbers while they pass through Python, as names may be odd.
    at = len(kept)
    plain = [f"c{i}" for i in range(at + 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, count in _bounds(batch.column(at), most):
                part = batch.slice(start, count)
                results = function(part.column(at)).flatten()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], *results], [*plain[:at], *new.names]
                )

    source = frame.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`")).toDF(*plain)
    passed = [T.StructField(n, f.dataType) for n, f in zip(plain, kept)]
    out = source.mapInArrow(released(work), T.StructType([*passed, *new.fields]))
    return out.toDF(*[f.name for f in kept], *new.names)


def _bounds(values: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Start and length of the slices of a column of texts or bytes."""
    start, held = 0, 0
    for end, size in enumerate(pa.compute.binary_length(values).to_pylist()):
        if end > start and held + (size or 0) > most:
            yield start, end - start
            start, held = end, 0
        held += size or 0
    if start < len(values):
        yield start, len(values) - start


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[list[str | None]]:
    """The texts as Python lists of bounded total size, in order."""
    for start, count in _bounds(texts, most):
        yield texts.slice(start, count).to_pylist()

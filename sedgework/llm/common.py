"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def light_batches(spark: SparkSession) -> None:
    """Rows hold whole texts here, so Arrow gets fewer of them at once than Spark's default, unless the session has chosen a number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    light_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the session names in ``spark.checkpoint.dir``. Only where that is unset (local
    tests) a temporary folder is set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sedgework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, keep: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession)}/sedgework-{uuid.uuid4().hex}"
    df.write.option("compression", keep).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every bit depends on every bit (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and the length of each text."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4"), np.fromiter(map(len, texts), np.int64, len(texts))


def tidy() -> None:
    """Give memory that a task has freed back to the system: workers are reused and idle beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_held: dict = {}


def held(key, make: Callable):
    """The one model that a worker keeps from task to task: another one, or ``forget``, lets it go, as workers serve all stages in turn."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Let go of the model of a stage before."""
    _held.clear()


def tidied(batches: Iterator) -> Iterator:
    """The batches of a task, then ``tidy``."""
    yield from batches
    tidy()


def by_text(df: DataFrame, column: str, maker: Callable, types: dict[str, str]) -> DataFrame:
    """Add columns computed in batches from one text column; all other columns pass as they are.

    ``maker()`` is called once in each task and gives the function of a batch's texts (a list with
    nulls) to its new columns. Columns of the new names are replaced.
    """
    df = df.drop(*types)
    schema = df.select("*", *[F.lit(None).cast(t).alias(n) for n, t in types.items()]).schema
    arrow = {"double": pa.float64(), "int": pa.int32(), "string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = maker()
        for whole in tidied(batches):
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                new = each(b.column(b.schema.get_field_index(column)).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(new[n], arrow[t]) for n, t in types.items())], names=[*b.schema.names, *types])

    return df.mapInArrow(run, schema)


def slices(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Cut a batch into runs of rows of at most ``most`` characters each (one row at least)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield slice(start, len(lengths))


def segments(starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut ranges into pieces of at most ``width``: the range of each piece, its start and length."""
    n = -(-lengths // width)
    of = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return of, starts[of] + nth * width, np.minimum(width, lengths[of] - nth * width)


class Bounded(dict):
    """A memo of a function of one key, emptied when it holds too many entries."""

    def __init__(self, make, most: int = 120_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.make(key)
        return out

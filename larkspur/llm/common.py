"""Helpers that the training-data operators share: durable intermediates, Arrow streaming, row ids."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that one Python step looks at; bounds the memory of a worker.
SLICE_ROWS = 512
#: Characters of text that one Python step looks at, however many rows they are.
SLICE_CHARS = 4_000_000
#: Rows and bytes of an Arrow batch at most, and rows that the Parquet reader holds at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 4096, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}
#: Bits of a filter of ids (2 to this power): 8 MB, however many ids there are.
FILTER_BITS = 26


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "/tmp/larkspur-shared"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once a session, so that they need no copy of their own, and keeps
    batches small (for the whole session): texts are long, and tasks share an executor's memory with their workers."""
    context = spark.sparkContext
    for name, most in BATCH.items():
        now = spark.conf.get(name)
        if now.startswith(("-", "0")) or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > most:
            spark.conf.set(name, str(most))
    if getattr(context, "_larkspur_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="larkspur-")) / "larkspur_code.zip"  # the driver serves it to executors
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, str(f.relative_to(top.parent)))
    context.addPyFile(str(archive))
    context._larkspur_shipped = True


def shipped(operator: Callable) -> Callable:
    """An operator that runs Python on executors: the code goes there first."""

    @functools.wraps(operator)
    def run(*args, **named):
        ship(next(a for a in (*args, *named.values()) if isinstance(a, DataFrame)).sparkSession)
        return operator(*args, **named)

    return run


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _written(spark: SparkSession) -> list[str]:
    if not hasattr(spark, "_larkspur_written"):
        spark._larkspur_written = []
    return spark._larkspur_written


def release(spark: SparkSession) -> int:
    """Deletes every intermediate this session wrote; call it once the results that read them are stored."""
    paths, jvm = _written(spark), spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    n = len(paths)
    paths.clear()
    return n


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 5, is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


# --- memory of workers: Spark reuses them, so what one operator holds would stay beside the next one's ----------------

_held: dict = {}


def begin(owner: str) -> None:
    """Lets go of what another operator keeps in this worker."""
    if _held and _held.get("owner") != owner:
        _held.clear()
        trim()
    _held["owner"] = owner


def kept(owner: str, key, make: Callable):
    """Something that a worker keeps for all its tasks of one operator, such as a tokenizer and its memo."""
    begin(owner)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def trim() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice holds at most SLICE_ROWS rows and about SLICE_CHARS bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(batch.schema.get_field_index(text)).nbytes
        step = max(1, min(SLICE_ROWS, int(SLICE_CHARS * batch.num_rows / max(sizes, 1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def by_slice(df: DataFrame, step: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | T.StructType, text: str = "text") -> DataFrame:
    """mapInArrow over bounded slices.  ``step()`` is called once a task and gives the function for a slice."""

    owner = step.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        one = step()
        for part in slices(batches, text):
            if (out := one(part)) is not None:
                yield out
        del one
        trim()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


@shipped
def may_be_among(ids: DataFrame) -> Callable[[Column], Column]:
    """Tells rows whose id may be among ``ids`` (one column) from those whose isn't, so that only few rows need a join.

    A bitmap of fixed size (2 ** FILTER_BITS bits) is made by tasks and goes to all; a full one lets every row pass, so
    a join must follow that is exact.  Only ids' places reach Python; the other columns stay where they are."""
    parts, mask = 64, (1 << FILTER_BITS) - 1
    cells = (1 << FILTER_BITS) // parts

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            at = column(b, "place").to_numpy()
            for part in np.unique(at // cells):
                bits = found.setdefault(int(part), np.zeros(cells, bool))
                bits[at[at // cells == part] % cells] = True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(x).tobytes() for x in found.values()], pa.binary())], names=["part", "bits"])

    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(mask))
    dealt = ids.select(place(F.col(ids.columns[0])).alias("place")).distinct().repartition(F.floor(F.col("place") / cells))
    got = {r.part: bytes(r.bits) for r in dealt.mapInArrow(gather, "part int, bits binary").collect()}  # 2 ** FILTER_BITS / 8 bytes
    sent = ids.sparkSession.sparkContext.broadcast(b"".join(got.get(k, b"\0" * (cells // 8)) for k in range(parts)))

    @F.arrow_udf("boolean")
    def hit(at: pa.Array) -> pa.Array:
        bits, at = np.frombuffer(sent.value, "uint8"), at.to_numpy()
        return pa.array(((bits[at >> 3] >> (7 - (at & 7)).astype("uint8")) & 1).astype(bool))

    return lambda c: hit(place(c))


def fresh(columns: Iterable[str], *names: str) -> tuple[str, ...]:
    """``names``, with underscores before those that a table has already."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return tuple(out)


def row_key(*cols: Column) -> Column:
    """A 64-bit hash that orders rows as if by chance, the same on every run."""
    return F.xxhash64(*cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)

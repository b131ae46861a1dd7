"""Blocks of documents, and the packed exchange that several operators share.

A *block* is one row ``(block, data)`` whose ``data`` is a compressed Arrow
stream of a few megabytes of documents. An operator that has to compare keys
across the whole corpus then runs in three distributed steps:

1. ``emit``: each block sends its distinct keys, packed by key range, to buckets;
2. ``resolve``: each bucket settles its keys and answers every block that asked;
3. ``settle``: each block meets its answers again and produces its documents.

A key counts once for each block, however often it occurs there, so one key that
holds a third of all rows adds no more to its bucket than any other key. Blocks
and buckets are bounded in bytes and grow in number with the input.
"""

from __future__ import annotations

import ctypes
import gc
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
BLOCK_SCHEMA = "split int, data binary"
EMIT_SCHEMA = "bucket int, block long, split int, data binary"
ANSWER_SCHEMA = "block long, bucket int, data binary"
#: Bits of a shared filter at most: 16 MB.
FILTER_BITS = 1 << 27
#: Stands for a null id, which orders after every other.
LAST_ID = np.iinfo(np.int64).max


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's spark.checkpoint.dir counts. Only a local master, whose tasks see the driver's folders, may do without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="semirel-checkpoint-"))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, even beside others that differ only in case."""
    return numbered(df)[f"c{df.columns.index(name)}"]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed by place, so that no two names can clash."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long, ``text`` as UTF-8 bytes, and the columns named ``more`` as they are."""
    n = numbered(docs)
    at = lambda name: n[f"c{docs.columns.index(name)}"]
    return n.select(
        at("doc_id").cast("long").alias("doc_id"), at("text").cast("string").cast("binary").alias("text"), *(at(x).alias(x) for x in more)
    )


def ids_of(table: pa.Table, name: str = "doc_id") -> np.ndarray:
    return table.column(name).fill_null(LAST_ID).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def texts_of(table: pa.Table, name: str = "text") -> list[bytes]:
    return [x or b"" for x in table.column(name).to_pylist()]


def tabled(df: DataFrame) -> DataFrame:
    """As ``saved``, for rows of plain numbers that later rounds join again and again: a written table has its true size, where
    a checkpoint keeps what the plan before it was estimated at, which every join multiplies by itself."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def looked_up(rows: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with ``known``, which has one row for each key.

    Each partition asks once for each of its keys and then meets the answers by itself: a key that a third of all rows
    share costs one row for each partition in the join, and its rows stay dealt over as many tasks as they were.
    """
    own = tabled(rows.withColumn("_part", F.spark_partition_id()))
    asked = own.select("_part", *keys).distinct()
    return own.join(asked.join(known, keys), ["_part", *keys]).drop("_part")


def few(rows: DataFrame, known: DataFrame, keys: dict[str, str], most: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``rows`` that may have a partner in ``known`` (saved), ``known``, and the rows that have none, for a join that need not deal out ``rows``.

    ``keys`` names the longs of ``rows`` and those of ``known`` that they are to equal. Up to ``most`` rows of ``known`` are broadcast, and all
    ``rows`` may have one. Beyond that a bit map of their hashes (FILTER_BITS at most, whatever ``known`` holds) is shared, and
    only rows whose bit is set, few but those with a partner, have to meet ``known``.
    """
    n = known.limit(most + 1).count()
    if n <= most:
        return rows, F.broadcast(known), None
    bits = min(FILTER_BITS, 1 << (64 * known.count() - 1).bit_length())
    page = min(bits, 1 << 15)
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(bits))

    def pack(table: pa.Table) -> pa.Table:
        own = np.zeros(page, bool)
        own[table.column("place").to_numpy() % page] = True
        return pa.table({"page": table.column("page").slice(0, 1), "data": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    at = known.select(place(keys.values()).alias("place")).distinct().withColumn("page", F.floor(F.col("place") / page).cast("long"))
    held = np.zeros(bits // 8, np.uint8)
    for k, data in at.groupBy("page").applyInArrow(pack, "page long, data binary").collect():
        held[k * page // 8 : (k + 1) * page // 8] = np.frombuffer(bytes(data), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def may(place: pa.Array) -> pa.Array:
        x = place.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool))

    hit = may(place(keys))
    return rows.where(hit), known, rows.where(~hit)


# --- memory of Python workers ---------------------------------------------------

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def relax() -> None:
    """Give memory that is free back to the system: reused workers would else keep the peak of every task they ran."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def map_rows(df: DataFrame, each: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema, rows: int = 256) -> DataFrame:
    """``mapInArrow`` over small slices, so that a worker holds the texts of a few rows at once and not of a whole batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, rows):
                    yield from each(batch.slice(i, rows))
        finally:
            relax()

    return df.mapInArrow(run, schema)


# --- packing -----------------------------------------------------------------

_PACK, _PACK_TEXT, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdCompressor(level=4), zstandard.ZstdDecompressor()


def dump(*arrays: np.ndarray | bytes, text: bool = False) -> bytes:
    """``text``: mostly text, for which more work pays."""
    parts = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in arrays]
    return (_PACK_TEXT if text else _PACK).compress(b"".join(struct.pack("<I", len(x)) for x in parts) + b"".join(parts))


def load(data: bytes, *kinds: str) -> list:
    """What ``dump`` packed; a kind is a numpy type, or ``bytes``."""
    raw, at, out = _UNPACK.decompress(data), 4 * len(kinds), []
    for kind, n in zip(kinds, struct.unpack(f"<{len(kinds)}I", raw[:at]), strict=True):
        out.append(raw[at : at + n] if kind == "bytes" else np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def gaps(sorted_keys: np.ndarray) -> np.ndarray:
    """Differences of ascending uint64 keys, which pack better than the keys."""
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def key_planes(sorted_keys: np.ndarray, shift: int) -> np.ndarray:
    """Ascending uint64 keys, whose last ``shift`` bits are zero, as the byte planes of their gaps; the high planes pack to nothing."""
    return np.ascontiguousarray((gaps(sorted_keys) >> np.uint64(shift)).view(np.uint8).reshape(-1, 8).T)


def keys_of_planes(planes: np.ndarray, shift: int) -> np.ndarray:
    whole = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(whole, dtype=np.uint64) << np.uint64(shift)


def bucket_bounds(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` even ranges of uint64 begins among the sorted keys; n + 1 places."""
    marks = [(i << 64) // n for i in range(1, n)]
    return np.concatenate(([0], np.searchsorted(sorted_keys, np.array(marks, np.uint64)), [len(sorted_keys)])).astype(np.int64)


# --- blocks ------------------------------------------------------------------


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))) as w:
        w.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def make_blocks(rows: DataFrame, block_bytes: int = BLOCK_BYTES, split_by: str | None = None) -> DataFrame:
    """``rows`` as saved blocks ``(block, split, data)``; a block holds rows of one value of ``split_by``.

    A single row longer than ``block_bytes`` makes a block of its own.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[pa.Table], int]] = {}

        def full(k: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"split": pa.array([k], pa.int32()), "data": pa.array([_pack(pa.concat_tables(held.pop(k)[0]))], pa.binary())})

        for batch in batches:
            table = pa.Table.from_batches([batch])
            parts = [(0, table)]
            if split_by:
                of = table.column(split_by).combine_chunks().to_numpy(zero_copy_only=False)
                parts = [(int(k), table.filter(pa.array(of == k)).drop_columns([split_by])) for k in np.unique(of)]
            for k, part in parts:
                step = max(1, int(part.num_rows * block_bytes / max(1, part.nbytes)))
                for i in range(0, part.num_rows, step):
                    piece = part.slice(i, step)
                    tables, size = held.get(k, ([], 0))
                    held[k] = ([*tables, piece], size + piece.nbytes)
                    if held[k][1] >= block_bytes:
                        yield full(k)
        for k in list(held):
            yield full(k)
        relax()

    blocks = rows.mapInArrow(run, BLOCK_SCHEMA).withColumn("block", F.monotonically_increasing_id())
    return saved(blocks)


def bucket_count(blocks: DataFrame, per_bucket: int = BUCKET_BYTES, weight: float = 1.0) -> int:
    """Buckets so that each settles about ``per_bucket`` packed bytes, and every partition has some."""
    size = blocks.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    shuffles = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * shuffles, int(size * weight) // per_bucket + 1)


def emit(blocks: DataFrame, keys: Callable[[int, pa.Table], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """Rows ``(bucket, block, split, data)`` of what ``keys(block, table)`` yields for every block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, split, data in zip(batch["block"].to_pylist(), batch["split"].to_pylist(), batch["data"], strict=True):
                out = list(keys(block, unpack(data.as_buffer())))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _ in out], pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array([split] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())],
                        names=["bucket", "block", "split", "data"],
                    )
                relax()

    return blocks.select("block", "split", "data").mapInArrow(run, EMIT_SCHEMA)


def answers(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    blocks, buckets, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array(buckets, pa.int32()), "data": pa.array(data, pa.binary())})


def resolve(emitted: DataFrame, settle: Callable[[int, list[int], list[bytes]], list[tuple[int, bytes]]]) -> DataFrame:
    """``settle(bucket, blocks, payloads)`` gives ``(block, answer)`` pairs for each bucket."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        out = settle(bucket, table.column("block").to_pylist(), table.column("data").to_pylist())
        relax()
        return answers([(b, bucket, x) for b, x in out])

    return emitted.select("bucket", "block", "data").groupBy("bucket").applyInArrow(run, ANSWER_SCHEMA)


def settle(blocks: DataFrame, answered: DataFrame, finish: Callable[[int, pa.Table, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """``finish(block, table, {bucket: answer})`` for each block, with no answer where there is none."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("an answer came for a block that does not exist")
        got = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True))
        out = finish(left.column("block")[0].as_py(), unpack(left.column("data")[0].as_buffer()), got)
        relax()
        return out

    return blocks.select("block", "data").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)

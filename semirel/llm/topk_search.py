"""Exact top-k inner product search over an impact-ordered index, a score at a time.

Each shard indexes its vectors by dimension. A posting's impact is the size of its
quantised component; the postings of all dimensions are cut into segments of like
impact and processed by descending impact, each adding to the scores of its vectors,
for a block of queries at once. What a vector's score may still change by is bounded
by the length of its part that is not processed yet, times the query's length. Once
the vectors that this bound leaves in play are few, processing stops for that query:
the others are proven out, and the rest are scored exactly. Without that proof every
segment is processed.

Queries meet all shards in blocks: a grid of shards by query blocks, each cell bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semirel.llm import blocks as B

K, SCALE, SHARD, QUERY_BLOCK, AT_ONCE, EXACT = 20, 64, 8192, 512, 32, 1 << 62
#: Shares of the postings after which a segment ends and the proof is tried.
CUTS = (0.6, 0.72, 0.82, 0.91, 1.0)


def quantise(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors count (no null or non-finite component), and each as floor(scale * x) of 64 bits; a component beyond them has no such number, which is an error."""
    keep, out = [], []
    flat = np.asarray(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    ends = np.cumsum(np.array([len(v) if v.is_valid else 0 for v in vectors], np.int64))
    for i, (valid, end) in enumerate(zip(vectors.is_valid().to_pylist(), ends.tolist(), strict=True)):
        part = flat[ends[i - 1] if i else 0 : end]
        if valid and np.isfinite(part).all():  # a null component reads as not a number
            keep.append(i)
            whole = np.floor(scale * part)
            if len(whole) and np.abs(whole).max() >= 2.0**63:
                raise OverflowError("a component times the scale is beyond 64 bits")
            out.append(whole.astype(np.int64))
    return np.array(keep, np.int64), out


class ImpactIndex:
    """Vectors of one shard; ``search`` gives for each query the places and scores of the ``k`` best, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order]).astype(np.int64)
        size = np.abs(self.vectors)
        lines = [int(np.quantile(size, 1 - c)) if size.size and c < 1 else 0 for c in CUTS]
        self.segments: list[tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]] = []
        above = np.full(1, np.iinfo(np.int64).max)
        for line in sorted(set(lines), reverse=True):  # impacts over the line, up to the one before
            now = (size > line) & (size <= above)
            postings = [(d, rows, self.vectors[rows, d]) for d in range(size.shape[1]) if len(rows := np.flatnonzero(now[:, d]))]
            left = np.where(size <= line, self.vectors, 0).astype(np.float64)
            self.segments.append((postings, np.sqrt((left * left).sum(axis=1))))
            above = np.full(1, line)
        self.processed = self.total = 0

    def _whole(self, queries: np.ndarray, k: int, lo: np.ndarray, hi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for q, i, j in zip(queries, lo.tolist(), hi.tolist(), strict=True):
            rows = np.concatenate([np.arange(i), np.arange(j, len(self.ids))])
            exact = self.vectors[rows].astype(object) @ q.astype(object)
            best = sorted(range(len(rows)), key=lambda r: (-exact[r], rows[r]))[:k]
            if any(abs(exact[r]) >= 1 << 63 for r in best):
                raise OverflowError("an inner product is beyond 64 bits")
            out.append((rows[best], np.array([exact[r] for r in best], np.int64)))
        return out

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        n = len(self.ids)
        queries = queries.astype(np.int64)
        lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        lo, hi = np.searchsorted(self.ids, own, side="left"), np.searchsorted(self.ids, own, side="right")
        few = max(4 * k, n // 16)
        longest = float(np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)) * float(lengths.max(initial=0))
        if longest >= EXACT:  # sums may pass 64 bits: Python's integers, without early stops
            return self._whole(queries, k, lo, hi)
        kind = np.int32 if longest < 1 << 30 else np.int64
        acc, active = np.zeros((n, len(queries)), kind), np.arange(len(queries))
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        self.total += n * queries.shape[1] * len(queries)
        for i, (postings, rest) in enumerate(self.segments):
            weights = queries[active].astype(kind)
            for d, rows, values in postings:
                acc[rows] += np.multiply.outer(values.astype(kind), weights[:, d])
                self.processed += len(rows) * len(active)
            slack = np.multiply.outer(rest, lengths[active]) * (1 + 1e-9)
            low = acc - slack
            for j, q in enumerate(active.tolist()):
                low[lo[q] : hi[q], j] = -np.inf
            others = n - (hi - lo)[active]
            line = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(active), -np.inf)
            in_play = acc + slack >= line
            last, going = i == len(self.segments) - 1, []
            counts = in_play.sum(axis=0)
            for j, q in enumerate(active.tolist()):
                if counts[j] > few and not last and others[j]:
                    going.append(j)
                    continue
                rows = np.flatnonzero(in_play[:, j])
                rows = rows[(rows < lo[q]) | (rows >= hi[q])]
                exact = self.vectors[rows] @ queries[q]
                best = np.lexsort((rows, -exact))[:k]
                out[q] = rows[best], exact[best]
            if not going:
                break
            if len(going) < len(active):
                acc, active = np.ascontiguousarray(acc[:, going]), active[going]
        return out


def top_k(vectors: DataFrame, queries: Column, *, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``queries`` (over the id, named ``vec_id``) holds, the ``k`` best others.

    Vectors that are null or hold null or non-finite components take no part, nor do rows
    with a null id. Shorter vectors count as padded with zeros. Rows that share the
    query's id count as its own; a repeated query row has results of its own, so its
    ranks occur as often. Fewer than ``k`` others: all of them. Empty table: no rows.
    """
    spark = vectors.sparkSession
    at, vec = f"c{vectors.columns.index(id_col)}", f"c{vectors.columns.index(vector_col)}"

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, ints = quantise(b["v"], scale)
            yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(keep)), pa.array([x.tobytes() for x in ints], pa.binary())], names=["vec_id", "v"])

    rows = B.numbered(vectors).select(F.col(at).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull())
    whole = B.saved(rows.mapInArrow(read, "vec_id long, v binary").withColumn("row", F.monotonically_increasing_id()).withColumn("asks", F.coalesce(queries, F.lit(False))))
    n, asking, width = whole.agg(F.count("*"), F.count(F.when(F.col("asks"), 1)), F.coalesce(F.max(F.length("v")), F.lit(0))).first()
    width //= 8
    shards = max(-(-n // SHARD), min(spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    blocks = max(-(-asking // QUERY_BLOCK), 1)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, row, ask = b["vec_id"].to_numpy(), b["row"].to_numpy(), np.array(b["asks"].to_pylist(), bool)
            flat = np.zeros((b.num_rows, width), np.int64)
            for i, v in enumerate(b["v"]):
                x = np.frombuffer(v.as_buffer(), np.int64)
                flat[i, : len(x)] = x
            mixed = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            shard, block = (mixed % np.uint64(shards)).astype(np.int64), (mixed % np.uint64(blocks)).astype(np.int64)
            out = [(s, False, B.dump(ids[shard == s], flat[shard == s])) for s in np.unique(shard).tolist()]
            out += [(k, True, B.dump(ids[mine], row[mine], flat[mine])) for k in np.unique(block[ask]).tolist() for mine in [ask & (block == k)]]
            at, asks, data = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(asks, pa.bool_()), pa.array(data, pa.binary())], names=["at", "asks", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All of a shard, or of a block of queries, as one row."""
        rows = [(b["at"][i].as_py(), b["asks"][i].as_py(), b["data"][i].as_buffer()) for b in batches for i in range(b.num_rows)]
        kinds = ["i8"] * (3 if rows[0][1] else 2)
        data = B.dump(*(np.concatenate(x) for x in zip(*(B.load(d, *kinds) for _, _, d in rows), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int64()), pa.array([rows[0][1]], pa.bool_()), pa.array([data], pa.binary())], names=["at", "asks", "data"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = None, None
        for b in batches:
            for i in range(b.num_rows):
                if index is None or shard != b["shard"][i].as_py():
                    shard, (ids, flat) = b["shard"][i].as_py(), B.load(b["held"][i].as_buffer(), "i8", "i8")
                    index = ImpactIndex(ids, flat.reshape(len(ids), width))
                own, row, flat = B.load(b["asked"][i].as_buffer(), "i8", "i8", "i8")
                flat = flat.reshape(len(own), width)
                for j in range(0, len(own), AT_ONCE):
                    part, out = slice(j, j + AT_ONCE), []
                    for q, r, (best, score) in zip(own[part].tolist(), row[part].tolist(), index.search(flat[part], k, own[part]), strict=True):
                        out.append((np.full(len(best), r), np.full(len(best), q), index.ids[best], score))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["row", "query_id", "vec_id", "score"])

    packed = B.saved(whole.mapInArrow(deal, "at long, asks boolean, data binary").groupBy("at", "asks").applyInArrow(gather, "at long, asks boolean, data binary"))
    # each shard meets each block of queries once: a grid of two short lists, whose cells are dealt by shard
    grid = packed.where("not asks").select(F.col("at").alias("shard"), F.col("data").alias("held"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    cells = grid.join(packed.where("asks").select(F.col("at").alias("block"), F.col("data").alias("asked")), "block")
    found = cells.repartition(min(shards * blocks, 4096), "shard", "block").mapInArrow(find, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

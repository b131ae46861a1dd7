"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of ascending ``doc_id``. What earlier batches have seen
is held as sorted runs of 128-bit line hashes, cut into the same hash ranges. A
batch is merged with the runs (an anti-join of sorted sequences): a hash that a run
holds was seen in an earlier document, the others form a new run of level 0. When
a level has ``fanout`` runs they are compacted into one run of the next level, so
that a batch never meets more than ``fanout - 1`` runs of each level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirel.llm import blocks as B

BATCHES, FANOUT, MIN_CHARS = 6, 3, 10
RUN_SCHEMA = "bucket int, data binary"
_BEFORE = np.iinfo(np.int64).min


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z in lower case."""
    return line.strip().lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _keys(table: pa.Table, least: int) -> tuple[list[tuple[int, list[bytes], list[int]]], np.ndarray, np.ndarray, np.ndarray]:
    """Each document as (id, lines, places of their keys or -1), and the sorted keys (two halves) with their smallest ids."""
    seen: dict[bytes, int] = {}
    lowest: list[int] = []
    rows = []
    for doc, text in zip(B.ids_of(table).tolist(), B.texts_of(table), strict=True):
        lines, at = text.split(b"\n"), []
        for line in lines:
            key = line_key(line)
            if not _long_enough(key, least):
                at.append(-1)
                continue
            i = seen.setdefault(xxhash.xxh3_128_digest(key), len(lowest))
            if i == len(lowest):
                lowest.append(doc)
            elif doc < lowest[i]:
                lowest[i] = doc
            at.append(i)
        rows.append((doc, lines, at))
    halves = np.frombuffer(b"".join(seen), ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    place = np.empty(len(order) + 1, np.int64)
    place[order], place[-1] = np.arange(len(order)), -1
    rows = [(doc, lines, place[at].tolist()) for doc, lines, at in rows]
    return rows, halves[order, 0], halves[order, 1], np.array(lowest, np.int64)[order]


def _merge(requests: pa.Table, runs: pa.Table) -> tuple[list[tuple[int, bytes]], bytes | None]:
    """Answers for the blocks of a batch in one bucket, and the bucket's new run."""
    asked = [B.load(x, "u8", "u8", "i8") for x in requests.column("data").to_pylist()]
    held = [B.load(x, "u8", "u8") for x in runs.column("data").to_pylist()]
    n_held, sizes = sum(len(h[0]) for h in held), [len(a[0]) for a in asked]
    hi = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in (*held, *asked)])
    lo = np.concatenate([x[1] for x in (*held, *asked)])
    doc = np.concatenate([np.full(n_held, _BEFORE), *(a[2] for a in asked)])
    order = np.lexsort((lo, hi))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(hi[order]) != 0) | (np.diff(lo[order]) != 0)
    group = np.cumsum(first) - 1
    lowest = np.minimum.reduceat(doc[order], np.flatnonzero(first)) if len(order) else doc
    least = np.empty(len(order), np.int64)
    least[order] = lowest[group]
    out, at = [], n_held
    for block, n, (_, _, own) in zip(requests.column("block").to_pylist(), sizes, asked, strict=True):
        lower = np.flatnonzero(least[at : at + n] < own)
        if len(lower):
            out.append((block, B.dump(lower.astype(np.int32), least[at : at + n][lower])))
        at += n
    new = order[np.flatnonzero(first)[lowest > _BEFORE]]
    return out, B.dump(B.gaps(hi[new]), lo[new]) if len(new) else None


def _compact(table: pa.Table) -> pa.Table:
    held = [B.load(x, "u8", "u8") for x in table.column("data").to_pylist()]
    hi, lo = np.concatenate([np.cumsum(h[0], dtype=np.uint64) for h in held]), np.concatenate([h[1] for h in held])
    order = np.lexsort((lo, hi))
    return pa.table({"bucket": pa.array(table.column("bucket").to_pylist()[:1], pa.int32()), "data": pa.array([B.dump(B.gaps(hi[order]), lo[order])], pa.binary())})


class LeveledRuns:
    """The sorted runs, newest level first. ``add`` compacts a level that is full."""

    def __init__(self, fanout: int):
        self.fanout, self.levels = fanout, [[]]

    def all(self, empty: DataFrame) -> DataFrame:
        out = empty
        for level in self.levels:
            for run in level:
                out = out.unionByName(run)
        return out

    def add(self, run: DataFrame, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, *rest = self.levels[level]
            for other in rest:
                merged = merged.unionByName(other)
            self.levels[level] = []
            self.add(B.saved(merged.groupBy("bucket").applyInArrow(_compact, RUN_SCHEMA)), level + 1)


def line_dedup(docs: DataFrame, *, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, keep_columns: bool = False) -> DataFrame:
    """Remove lines that a document with a smaller ``doc_id`` holds too.

    Lines are split at ``\\n`` and compared by ``line_key``; keys under ``min_chars``
    code points always stay. Returns ``doc_id, text, n_lines, n_dropped`` for each
    row, or with ``keep_columns`` the input's own columns with the new text (and
    ``n_chars`` counted anew if there is one).

    Null or empty text: one empty line. Null ``doc_id``: orders after all others and
    removes nothing from its like. Rows that repeat a ``doc_id`` count as the same
    document: they never remove each other's lines. Empty table: no rows. Extra
    columns never matter, whatever their names.
    """
    spark, names = docs.sparkSession, docs.columns
    cuts = [float(b) for b in B.id_and_text(docs).approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)] if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    rows = B.numbered(docs)
    key, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    which = F.lit(0)
    for c in cuts:
        which = which + F.when(F.col(key).isNull() | (F.col(key) > c), 1).otherwise(0)
    source = rows.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"), *([F.struct(*(x for x in rows.columns if x != text)).alias("rest")] if keep_columns else []), which.cast("int").alias("batch"))
    blocks = B.make_blocks(source, split_by="batch")
    n = B.bucket_count(blocks, weight=0.5)

    def ask(_: int, table: pa.Table) -> Iterator[tuple[int, bytes]]:
        _, hi, lo, lowest = _keys(table, min_chars)
        ends = B.bucket_bounds(hi, n)
        for k in np.flatnonzero(np.diff(ends)).tolist():
            part = slice(ends[k], ends[k + 1])
            yield k, B.dump(B.gaps(hi[part]), lo[part], lowest[part])

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return B.answers([])
        bucket = left.column("bucket")[0].as_py()
        out, run = _merge(left, right)
        B.relax()
        return B.answers([*((b, bucket, x) for b, x in out), *([(-1, bucket, run)] if run else [])])

    asked = B.saved(B.emit(blocks, ask))
    runs, empty = LeveledRuns(fanout), spark.createDataFrame([], RUN_SCHEMA)
    answered = None
    for k in range(len(cuts) + 1):
        batch = asked.where(F.col("split") == k).select("bucket", "block", "data")
        met = B.saved(batch.groupBy("bucket").cogroup(runs.all(empty).groupBy("bucket")).applyInArrow(merge, B.ANSWER_SCHEMA))
        told = met.where("block >= 0")
        answered = told if answered is None else answered.unionByName(told)
        if k < len(cuts):
            runs.add(met.where("block < 0").select("bucket", "data"))

    def finish(_: int, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        rows, hi, _, keep = _keys(table, min_chars)
        ends = B.bucket_bounds(hi, n)
        for k, data in got.items():
            at, least = B.load(data, "i4", "i8")
            keep[at + ends[k]] = least
        kept, counts, dropped = [], [], []
        keep = np.append(keep, B.LAST_ID).tolist()
        for doc, lines, at in rows:
            left = [line for line, i in zip(lines, at, strict=True) if doc <= keep[i]]
            kept.append(b"\n".join(left))
            counts.append(len(lines))
            dropped.append(len(lines) - len(left))
        new = pa.array(kept, pa.binary()).cast(pa.string())
        if keep_columns:
            return pa.table({"text": new, "rest": table.column("rest")})
        return pa.table({"doc_id": table.column("doc_id"), "text": new, "n_lines": pa.array(counts, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

    if not keep_columns:
        return B.settle(blocks, answered, finish, "doc_id long, text string, n_lines long, n_dropped long")
    kind = source.schema["rest"].dataType.simpleString()
    out = B.settle(blocks, answered, finish, f"text string, rest {kind}")
    fresh = lambda i, name: F.col("text") if f"c{i}" == text else F.length("text").cast(docs.schema[i].dataType) if name == "n_chars" else F.col(f"rest.c{i}")
    return out.select(*(fresh(i, name).alias(name) for i, name in enumerate(names)))

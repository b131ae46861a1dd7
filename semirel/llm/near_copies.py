"""Near copies by word shingles: SimHash candidates, then the exact Jaccard similarity.

Exact copies (equal words) form one class and are compared once. Classes whose fingerprints
a vantage-point tree (``simhash``) finds within a few bits, where it still prunes, are compared first:
each with the first one of its star, so that a group of copies gives no more pairs than members.
Then nothing is left to the fingerprints. Sets of the similarity share a shingle of their first
few in any common order (rare ones first here). Of the classes that hold such a shingle each is
compared with one leader, and what then still stands in different groups is compared with all
others of it that may have the similarity. Sizes, places in the order, a small signature of each set and one that
grows with the set, all exact bounds, rule out most pairs before a set is read.

What moves is small: leading shingles travel once, to find those that several classes hold; the rounds work on these
alone. Texts stay where they are; only those that a filter of bounded size lets through ever meet in a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirel.llm import blocks as B
from semirel.llm import simhash as S
from semirel.llm.decontamination import BROADCAST_ROWS

WIDTH, SIMILARITY, CLOSE = 5, 0.8, 3
#: Texts from which the common order learns what is frequent, frequent shingles that it knows, and leading shingles that a
#: bucket settles, and pairs that it holds at once. These change what is compared at most, never what is found: any one order is exact.
ORDER_TEXTS, ORDER_KEYS, BUCKET_KEYS, LEAD_PAIRS = 1 << 13, 1 << 17, 1 << 17, 1 << 17
#: Numbers of a signature: how many shingles of the set fall to each place (255 at most).
SIGNATURE = 128
#: A fine signature has a power of two of places, from a quarter to an eighth of the set's size but SIGNATURE at least.
FINE_PART = 4
#: Low bits of a leading shingle's hash that do not travel. Sets that share a shingle share the rest of it; others that do are a few pairs more to rule out.
KEY_SHIFT = 24
#: Rounds with leaders at most, while they still find copies. More rounds leave fewer pairs to the last, exact one.
LEADER_ROUNDS = 2


def shingle_set(text: bytes, width: int) -> np.ndarray:
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, S.SEED) for x in S.shingles(text, width)), np.uint64))


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of some texts hold, ascending, and in how many."""
    rows = B.id_and_text(docs)
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, rows.count() // ORDER_TEXTS))) == 0)

    def each(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held = [shingle_set(x or b"", width) for x in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["shingle"])

    counted = B.map_rows(some.select("text"), each, "shingle long").groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(ORDER_KEYS).collect()
    keys, times = np.array([r[0] for r in counted], np.int64).view(np.uint64), np.array([r[1] for r in counted], np.int64)
    order = np.argsort(keys)
    return keys[order], times[order]


def leading(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Of a set (ascending) the first shingles, rare ones before frequent ones, one of which any set of the similarity shares."""
    keys, times = frequent
    n = len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1 if len(found) else 0
    if not len(keys):
        return found[:n]
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return found[np.argsort(np.where(keys[at] == found, times[at], 0), kind="stable")[:n]]


def signature(found: np.ndarray, places: int = SIGNATURE) -> bytes:
    """The differences of two signatures add up to no more than the sets differ by. ``places`` is a power of two."""
    at = (found >> np.uint64(65 - places.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=places), 255).astype(np.uint8).tobytes()


def fine_signature(found: np.ndarray) -> bytes:
    return signature(found, 1 << max(SIGNATURE.bit_length() - 1, (len(found) // FINE_PART).bit_length() - 1))


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """How much two fine signatures differ: no more than their sets do. The finer one's places are added up first."""
    n = min(len(x), len(y))
    x, y = (np.minimum(z.reshape(n, -1).sum(axis=1, dtype=np.int64), 255) for z in (x, y))
    return int(np.abs(x - y).sum())


def _short(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, KEY_SHIFT // 8 :]).tobytes()


def _keys(short: bytes | memoryview) -> np.ndarray:
    part = np.frombuffer(short, np.uint8).reshape(-1, 8 - KEY_SHIFT // 8)
    whole = np.zeros((len(part), 8), np.uint8)
    whole[:, KEY_SHIFT // 8 :] = part
    return whole.view("<u8").ravel()


def _sketches(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``doc_id, text_hash, words_hash (two longs), fp, size, leading, signature, fine`` for each row; ``fp`` is that of the distinct shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))  # at most ORDER_KEYS keys, whatever the corpus

    def each(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text in b["text"].to_pylist():
            text = text or b""
            found = shingle_set(text, width)
            d = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(text.lower().split())), "<i8")
            out.append((int(d[0]), int(d[1]), int(np.uint64(S.majority(found)).view(np.int64)), len(found), _short(leading(found, shared.value, similarity)), signature(found), fine_signature(found)))
        *numbers, keys, marks, fine = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], *(pa.array(c, pa.int64()) for c in numbers), *(pa.array(c, pa.binary()) for c in (keys, marks, fine))], names=["doc_id", "text_hash", "h1", "h2", "fp", "size", "leading", "signature", "fine"])

    rows = B.id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return B.map_rows(rows, each, "doc_id long, text_hash long, h1 long, h2 long, fp long, size long, leading binary, signature binary, fine binary")


# --- pairs that share a leading shingle -------------------------------------------


def _later(key: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place (ordered by key, then label) where its label ends and where its key ends."""
    new = np.append(np.diff(key) != 0, True)
    change = new | np.append(np.diff(label) != 0, True)
    ends = (np.flatnonzero(x) for x in (change, new))
    return tuple(e[np.searchsorted(e, np.arange(len(key)))] + 1 for e in ends)


def _possible(a: np.ndarray, b: np.ndarray, size: np.ndarray, at: np.ndarray, marks: np.ndarray | None, similarity: float) -> np.ndarray:
    """Which pairs of places may have the similarity: sets that do are of like size, share at least a part of the sum of their sizes and differ by no more than the rest."""
    total = size[a] + size[b]
    # at their first common shingle no more than the shorter rest can be common
    keep = np.minimum(size[a] - at[a], size[b] - at[b]) >= similarity / (1 + similarity) * total - 1e-6
    keep &= np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-6
    if marks is not None:
        some = np.flatnonzero(keep)
        apart = np.abs(marks[a[some]].astype(np.int16) - marks[b[some]]).sum(axis=1)
        keep[some] = apart <= (1 - similarity) / (1 + similarity) * total[some] + 1e-6
    return keep


def _across(key: np.ndarray, size: np.ndarray, label: np.ndarray, at: np.ndarray, similarity: float, marks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs that share a key (ordered by key, then label) under different labels and may have the similarity, some at a time."""
    if not len(key):
        return
    label_end, run_end = _later(key, label)
    begins = np.concatenate(([0], np.cumsum(run_end - label_end)))
    i, n = 0, len(key)
    while i < n:
        # as many whole rows as LEAD_PAIRS allows, or a part of one row
        j = max(i + 1, int(np.searchsorted(begins, begins[i] + LEAD_PAIRS, side="right")) - 1)
        counts = (run_end - label_end)[i:j]
        total = int(counts.sum())
        for lo in range(0, total, LEAD_PAIRS):
            k = np.arange(lo, min(total, lo + LEAD_PAIRS))
            row = np.searchsorted(begins[i : j + 1] - begins[i], k, side="right") - 1
            a, b = i + row, label_end[i + row] + k - (begins[i + row] - begins[i])
            keep = _possible(a, b, size, at, marks, similarity)
            if keep.any():
                yield a[keep], b[keep]
        i = j


def _with_leaders(key: np.ndarray, cls: np.ndarray, size: np.ndarray, label: np.ndarray, at: np.ndarray, similarity: float, marks: np.ndarray | None = None, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of each class and its key's leader, the one of the smallest hash, which is mostly the same for the keys of one group."""
    with np.errstate(over="ignore"):
        mixed = (cls.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort(((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93), key))
    first = np.ones(len(key), bool)
    first[1:] = np.diff(key[order]) != 0
    lead = np.empty(len(key), np.int64)
    lead[order] = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    a = np.flatnonzero(label != label[lead])
    keep = _possible(a, lead[a], size, at, marks, similarity)
    return a[keep], lead[a[keep]]


def _held(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's leading shingles, ascending, each with its class's place and its own place in the class's order."""
    sets = [_keys(x.as_buffer()) for x in table.column("leading")]
    key = np.concatenate([np.zeros(0, np.uint64), *sets])
    order = np.argsort(key, kind="stable")
    of = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    if "places" in table.column_names:
        at = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x.as_buffer(), np.int32) for x in table.column("places"))])
    else:
        at = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(x), dtype=np.int32) for x in sets)])
    return key[order], of[order], at[order]


def _lead_buckets(classes: DataFrame, per_bucket: int) -> int:
    return max(1, classes.agg(F.coalesce(F.sum(F.length("leading")), F.lit(0))).first()[0] // (8 - KEY_SHIFT // 8) // per_bucket)


def _wanted(key: np.ndarray, got: dict[int, bytes]) -> np.ndarray:
    """Which of the ascending keys the answers name."""
    wanted = np.sort(np.concatenate([B.keys_of_planes(B.load(x, "u1")[0], KEY_SHIFT) for x in got.values()]))
    return wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key


def held_by_several(classes: DataFrame) -> DataFrame:
    """``cls, size, leading, places, signature`` of the classes with a leading shingle that another class has among its own, with these shingles
    only and their places. All others can give no pair, whatever is united meanwhile, so they travel this once, as a few bytes each."""
    blocks = B.make_blocks(classes.select("cls", "size", "leading", "signature"))
    n = _lead_buckets(classes, 4 * BUCKET_KEYS)

    def ask(_: int, table: pa.Table) -> Iterator[tuple[int, bytes]]:
        key, of, _ = _held(table)
        own, begins = np.unique(key, return_index=True)
        more = np.minimum.reduceat(of, begins) != np.maximum.reduceat(of, begins) if len(own) else np.zeros(0, bool)
        bounds = B.bucket_bounds(own, n)
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[k], bounds[k + 1])
            yield k, B.dump(B.key_planes(own[part], KEY_SHIFT), np.packbits(more[part]))

    def several(_: int, which: list[int], payloads: list[bytes]) -> list[tuple[int, bytes]]:
        asked = [B.load(x, "u1", "u1") for x in payloads]
        own = [B.keys_of_planes(a[0], KEY_SHIFT) for a in asked]
        key, times = np.unique(np.concatenate(own), return_counts=True)
        within = np.concatenate([x[np.unpackbits(a[1], count=len(x)).astype(bool)] for x, a in zip(own, asked, strict=True)])
        mixed = np.union1d(key[times > 1], within)
        shared = ((block, np.intersect1d(x, mixed, assume_unique=True)) for block, x in zip(which, own, strict=True))
        return [(block, B.dump(B.key_planes(mine, KEY_SHIFT))) for block, mine in shared if len(mine)]

    def finish(_: int, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        key, of, at = _held(table)
        mine = _wanted(key, got) if got else np.zeros(len(key), bool)
        key, of, at = key[mine], of[mine], at[mine]
        order = np.lexsort((at, of))
        key, of, at = key[order], of[order], at[order]
        some, begins = np.unique(of, return_index=True)
        cuts = [slice(i, j) for i, j in zip(begins, np.append(begins[1:], len(of))[: len(begins)], strict=True)]  # a block may hold none
        rows = table.take(pa.array(some, pa.int64()))
        return pa.table({"cls": rows.column("cls"), "size": rows.column("size"), "leading": pa.array([_short(key[c]) for c in cuts], pa.binary()), "places": pa.array([at[c].tobytes() for c in cuts], pa.binary()), "signature": rows.column("signature")})

    return B.saved(B.settle(blocks, B.resolve(B.emit(blocks, ask), several), finish, "cls long, size long, leading binary, places binary, signature binary"))


def shared_leads(classes: DataFrame, *, similarity: float, leaders: int | None) -> DataFrame:
    """``a, b`` of classes (of ``held_by_several``) with different ``label`` that share one of their ``leading`` shingles and may have the similarity:
    with ``leaders`` each class with one other of each shingle, chosen anew for each number, else all.

    Blocks first ask which of their shingles classes of other labels hold; only those shingles then travel with what is known of their classes.
    """
    blocks = B.make_blocks(classes.select("cls", "size", "label", "leading", "places", "signature"))
    n = _lead_buckets(classes, BUCKET_KEYS)

    def ask(_: int, table: pa.Table) -> Iterator[tuple[int, bytes]]:
        key, of, _ = _held(table)
        label = table.column("label").to_numpy()[of]
        new = np.ones(len(key), bool)
        new[1:] = (np.diff(key) != 0) | (np.diff(label) != 0)
        key, label = key[new], label[new]
        bounds = B.bucket_bounds(key, n)
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[k], bounds[k + 1])
            yield k, B.dump(B.key_planes(key[part], KEY_SHIFT), label[part])

    def several(_: int, which: list[int], payloads: list[bytes]) -> list[tuple[int, bytes]]:
        asked = [B.load(x, "u1", "i8") for x in payloads]
        own = [B.keys_of_planes(a[0], KEY_SHIFT) for a in asked]
        key, label = np.concatenate(own), np.concatenate([a[1] for a in asked])
        order = np.argsort(key, kind="stable")
        key, label = key[order], label[order]
        first = np.ones(len(key), bool)
        first[1:] = np.diff(key) != 0
        begins = np.flatnonzero(first)
        mixed = key[begins[np.minimum.reduceat(label, begins) != np.maximum.reduceat(label, begins)]] if len(key) else key
        out = []
        for block, x in zip(which, own, strict=True):
            mine = np.intersect1d(x, mixed)
            if len(mine):
                out.append((block, B.dump(B.key_planes(mine, KEY_SHIFT))))
        return out

    def finish(_: int, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        out = []
        if got:
            key, of, at = _held(table)
            mine = _wanted(key, got)
            key, of, at = key[mine], of[mine], at[mine]
            bounds = B.bucket_bounds(key, n)
            numbers = [table.column(c).to_numpy() for c in ("cls", "size", "label")]
            marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                part = slice(bounds[k], bounds[k + 1])
                some, place = np.unique(of[part], return_inverse=True)
                out.append((k, B.dump(B.key_planes(key[part], KEY_SHIFT), place.astype(np.int32), at[part], *(x[some] for x in numbers), marks[some])))
        return pa.table({"bucket": pa.array([k for k, _ in out], pa.int32()), "data": pa.array([d for _, d in out], pa.binary())})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [B.load(d.as_buffer(), "u1", "i4", "i4", "i8", "i8", "i8", "u1") for b in batches for d in b["data"]]
        key = np.concatenate([B.keys_of_planes(p[0], KEY_SHIFT) for p in parts])
        at = np.concatenate([p[2] for p in parts])
        cls, size, label = (np.concatenate([p[c][p[1]] for p in parts]) for c in (3, 4, 5))
        shift = np.cumsum([0, *(len(p[3]) for p in parts)])
        marks, place = np.concatenate([p[6].reshape(-1, SIGNATURE) for p in parts]), np.concatenate([p[1] + d for p, d in zip(parts, shift, strict=False)])
        order = np.lexsort((cls, label, key))
        key, at, cls, size, label, place = (x[order] for x in (key, at, cls, size, label, place))
        marks = marks[place]
        found = [_with_leaders(key, cls, size, label, at, similarity, marks, leaders)] if leaders is not None else _across(key, size, label, at, similarity, marks)
        for a, b in found:
            pairs = np.unique(np.stack([np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        B.relax()

    dealt = B.settle(blocks, B.resolve(B.emit(blocks, ask), several), finish, "bucket int, data binary")
    return dealt.groupBy("bucket").applyInArrow(find, "a long, b long").distinct()


# --- verification -------------------------------------------------------------------


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()


def _like(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` that their sizes and fine signatures do not rule out."""
    known, ends, _ = B.few(classes.select("cls", "size", "fine"), B.tabled(_ends(pairs)), {"cls": "cls"}, BROADCAST_ROWS)
    known = known.join(ends, "cls", "left_semi")
    at = lambda end: known.select(F.col("cls").alias(end), F.col("size").alias(f"size_{end}"), F.col("fine").alias(f"fine_{end}"))

    def like(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        far = np.array([apart(*(np.frombuffer(z.as_buffer(), np.uint8) for z in pair)) for pair in zip(b["fine_a"], b["fine_b"], strict=True)], np.int64)
        total = b["size_a"].to_numpy() + b["size_b"].to_numpy()
        keep = far <= (1 - similarity) / (1 + similarity) * total + 1e-6
        yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return B.tabled(B.map_rows(pairs.join(at("a"), "a").join(at("b"), "b"), like, "a long, b long"))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``a, b`` whose shingle sets have at least the similarity; only the documents of these classes are read again."""
    pairs = _like(pairs, classes, similarity)
    wanted = B.tabled(classes.join(_ends(pairs), "cls").select("cls", F.col("first").alias("doc_id"), "text_hash"))

    def sets(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([b["cls"], pa.array([shingle_set(x or b"", width).tobytes() for x in b["text"].to_pylist()], pa.binary())], names=["cls", "set"])

    rows = B.id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    some, known, _ = B.few(rows, wanted, {"doc_id": "doc_id", "text_hash": "text_hash"}, BROADCAST_ROWS)
    own = B.saved(B.map_rows(some.join(known, ["doc_id", "text_hash"]).select("cls", "text"), sets, "cls long, set binary"))
    if not own.groupBy("cls").count().where("count > 1").isEmpty():  # repeated rows
        own = own.dropDuplicates(["cls"])
    both = pairs.join(own.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a").join(own.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b")

    def similar(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for x, y in zip(b["x"], b["y"], strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(both >= similarity * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return B.map_rows(both.select("a", "b", "x", "y"), similar, "a long, b long")


def _close_pairs(usable: DataFrame, close: int) -> DataFrame:
    """``a, b``: each class with the first of its fingerprint, and that one with the first of its star."""
    usable = B.tabled(usable.select("fp", "cls"))
    of_fp = B.tabled(usable.groupBy("fp").agg(F.min("cls").alias("first_cls")))
    same = B.looked_up(usable.select("fp", "cls"), ["fp"], of_fp).select(F.col("first_cls").alias("a"), F.col("cls").alias("b"))
    star = S.stars(of_fp.select("fp"), of_fp.count(), close)
    led = star.join(of_fp, "fp").select("lead", F.col("first_cls").alias("b")).join(of_fp.select(F.col("fp").alias("lead"), F.col("first_cls").alias("a")), "lead").select("a", "b")
    return same.union(led).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copy_classes(docs: DataFrame, *, width: int = WIDTH, similarity: float = SIMILARITY, close: int = CLOSE) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_hash, h1, h2`` for each row, and for each class ``h1, h2, first, text_hash, group_id``."""
    sketches = B.saved(_sketches(docs, width, similarity))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    classes = sketches.groupBy("h1", "h2").agg(F.min_by(F.struct("doc_id", "text_hash"), order).alias("r"), *(F.first(c).alias(c) for c in ("fp", "size", "leading", "signature", "fine")))
    classes = B.saved(classes.select("h1", "h2", F.col("r.doc_id").alias("first"), F.col("r.text_hash").alias("text_hash"), "fp", "size", "leading", "signature", "fine").withColumn("cls", F.monotonically_increasing_id()))
    usable = classes.where((F.col("size") > 0) & F.col("first").isNotNull())
    leads = held_by_several(usable)
    seen, links, labels = None, None, None
    found, rounds = 1, ["close", *range(LEADER_ROUNDS), "all"]
    for turn in rounds:
        if isinstance(turn, int) and turn and not found:
            continue  # the leaders before united nothing
        now = leads.withColumn("label", F.col("cls")) if labels is None else leads.join(labels, "cls", "left").withColumn("label", F.coalesce("root", "cls"))
        pairs = _close_pairs(usable, close) if turn == "close" else shared_leads(now, similarity=similarity, leaders=turn if isinstance(turn, int) else None)
        pairs = B.tabled(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"))
        seen = pairs if seen is None else seen.union(pairs)
        if pairs.isEmpty():
            found = 0
            continue
        more = B.tabled(_verified(pairs, classes, docs, width, similarity))
        found = more.count()
        links = more if links is None else links.union(more)
        labels = _labels(links)
    whole = classes.withColumn("group_id", F.col("cls")) if labels is None else classes.join(labels, "cls", "left").withColumn("group_id", F.coalesce("root", "cls"))
    return sketches.select("doc_id", "text_hash", "h1", "h2"), whole.select("h1", "h2", "first", "text_hash", "group_id")


def near_copy_groups(docs: DataFrame, **how: float) -> DataFrame:
    """``doc_id, text_hash, group_id`` for each row: documents of one group are linked by Jaccard similarities of
    ``width``-word shingle sets of at least ``similarity``, however far their fingerprints differ: ``close`` only says
    which are compared first.

    Null and empty texts are exact copies of each other. Texts of fewer than ``width``
    words are one shingle. Null ``doc_id``: only exact copies of it are found. Repeated
    rows are copies. Extra columns never matter. Empty table: no rows.
    """
    rows, classes = near_copy_classes(docs, **how)
    return B.looked_up(rows, ["h1", "h2"], classes.select("h1", "h2", "group_id")).select("doc_id", "text_hash", "group_id")


def _labels(links: DataFrame) -> DataFrame | None:
    if links.isEmpty():
        return None
    return S.components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("cls"), "root")


def drop_near_copies(docs: DataFrame, **how: float) -> DataFrame:
    """One row of each group of ``near_copy_groups`` stays, that with the smallest ``doc_id`` (null last; of its rows the
    one of the smallest text hash); rows keep their own columns.

    Only the first row of a class can stay, so the rows of a class that a third of all share never meet. Null and empty
    texts are one group; repeated rows and null ids lose all rows but one of their group. Extra columns stay, whatever their names. Empty table: no rows.
    """
    each, classes = near_copy_classes(docs, **how)
    order = F.struct(F.col("first").isNull(), "first", "text_hash")
    stays = classes.groupBy("group_id").agg(F.min_by(F.struct("first", "text_hash"), order).alias("r")).select(F.col("r.first").alias("d"), F.col("r.text_hash").alias("t"))
    goes = B.tabled(each.join(stays, each["doc_id"].eqNullSafe(stays["d"]) & (each["text_hash"] == stays["t"]), "left_anti").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct())
    key, text = (f"c{docs.columns.index(x)}" for x in ("doc_id", "text"))
    rows = B.numbered(docs).withColumn("_id", F.col(key).cast("long")).withColumn("_hash", F.xxhash64(F.col(text).cast("string").cast("binary")))
    some, goes, others = B.few(rows, goes, {"_id": "d", "_hash": "t"}, BROADCAST_ROWS)
    kept = some.join(goes, some["_id"].eqNullSafe(goes["d"]) & (some["_hash"] == goes["t"]), "left_anti")
    kept = kept if others is None else kept.union(others)
    if not each.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():  # repeated rows
        kept = kept.dropDuplicates([key, "_hash"])
    return kept.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)))

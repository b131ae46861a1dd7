"""SimHash near-dedup with vantage-point trees.

Distinct fingerprints are dealt to the leaves (shards) of a vantage-point tree over
Hamming distance, whose vantage points and radii come from a bounded sample. By the
triangle inequality a fingerprint within ``max_bits`` of another one can only lie in
a leaf that its own ball reaches; so each fingerprint also visits the leaves beyond
its own whose boundary its ball crosses. Within a leaf the same pruning goes on in
memory until small sets are compared bit by bit: the links found are exact and whole.

A leaf never emits all pairs of a group. It unites what is linked and emits one row
for each linked fingerprint, ``(fingerprint, star)``; stars that share a fingerprint
are then joined by distributed label propagation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirel.llm import blocks as B

LEAF, SAMPLE_PER_LEAF, MAX_SAMPLE, SMALL = 4096, 32, 1 << 16, 192
SEED = 42


def shingles(text: bytes, width: int) -> list[bytes]:
    """Runs of ``width`` words, repeats included; with fewer words the whole sequence, with none nothing."""
    words = text.lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[s:e] for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def simhash(text: bytes, width: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 values."""
    parts = shingles(text, width)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(x, SEED) for x in parts), "<u8", len(parts)))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` for each row; ``fp`` holds the 64 bits as a long."""

    def each(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.fromiter((simhash(x or b"", width) for x in b["text"].to_pylist()), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp)], names=["doc_id", "fp"])

    return B.map_rows(B.id_and_text(docs), each, "doc_id long, fp long")


# --- the tree ----------------------------------------------------------------


def _distance(x: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint64(point)).astype(np.int16)


def build_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """Levels of ``(vantage point, radius)`` as an implicit binary tree over the sample; node i has children 2i+1 and 2i+2."""
    depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
    nodes: list[tuple[int, int]] = []
    sets = [np.unique(sample)]
    for _ in range(depth):
        below = []
        for s in sets:
            if len(s) < 2:
                nodes.append((0, 64))
                below += [s, s[:0]]
                continue
            tries = [(int(np.var(d := _distance(s, p), dtype=np.float64) * 1000), int(p), int(np.median(d))) for p in s[:: max(1, len(s) // 8)][:8]]
            _, point, radius = max(tries)
            d = _distance(s, point)
            nodes.append((point, radius))
            below += [s[d <= radius], s[d > radius]]
        sets = below
    return nodes


def homes(fps: np.ndarray, tree: list[tuple[int, int]]) -> np.ndarray:
    """The leaf of each fingerprint."""
    node = np.zeros(len(fps), np.int64)
    points, radii = (np.array([t[i] for t in tree], np.uint64) for i in (0, 1))
    while len(tree) and node[:1].size and node[0] < len(tree):  # all leaves lie equally deep
        inside = np.bitwise_count(fps ^ points[node]) <= radii[node]
        node = 2 * node + np.where(inside, 1, 2)
    return node - len(tree)


def _hosts(leaf: int, other: np.ndarray) -> np.ndarray:
    """Whether pairs between ``leaf`` and each other leaf meet in ``leaf``: by a hash of the two, so that no leaf takes more than about half of its neighbours."""
    low, high = np.minimum(leaf, other).astype(np.uint64), np.maximum(leaf, other).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (low * np.uint64(0x9E3779B97F4A7C15) ^ high) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(63)).astype(bool) == (other > leaf)


def route(fps: np.ndarray, tree: list[tuple[int, int]], reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(leaf, fingerprints at home, visitors)``; a pair of two leaves meets in one of them."""
    own = homes(fps, tree)
    todo = [(0, np.arange(len(fps)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if node >= len(tree):
            leaf = node - len(tree)
            home = own[at] == leaf
            visits = ~home
            visits[visits] = _hosts(leaf, own[at[visits]])
            if home.any() or visits.any():
                yield leaf, fps[at[home]], fps[at[visits]]
            continue
        point, radius = tree[node]
        d = _distance(fps[at], point)
        todo.append((2 * node + 1, at[d - reach <= radius]))
        todo.append((2 * node + 2, at[d + reach > radius]))


def task_parts(sample: np.ndarray, tree: list[tuple[int, int]], reach: int, total: int, leaf_size: int) -> np.ndarray:
    """Over how many tasks each leaf's visitors are spread, and each leaf's own, as the sample foretells: each task holds about ``leaf_size`` of
    either. Leaves of a growing tree get more visitors, and so more tasks, but no larger ones."""
    load = np.zeros((2, len(tree) + 1), np.int64)
    for leaf, home, visitors in route(sample, tree, reach):
        load[:, leaf] = len(home), len(visitors)
    # what a thin sample does not show: a few more than seen, by the square root of a count
    foretold = (load + np.sqrt(load) + 1) * (total / max(1, len(sample)))
    return np.maximum(1, np.ceil(foretold / (2 * leaf_size))).astype(np.int64)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def linked(home: np.ndarray, visitors: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """All fingerprints (distinct at home, then visitors), and for each the place of the first one in its component."""
    x = np.concatenate([home, visitors])
    parent = np.arange(len(x))

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal parent
        while len(a):
            ra, rb = parent[a], parent[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            parent = _roots(parent)

    todo = [(np.arange(len(home)), np.arange(len(x)), 0)]
    while todo:
        h, v, depth = todo.pop()
        if not len(h) or not len(v):
            continue
        if len(h) > SMALL and depth < 24:
            point = x[h[(depth * 7919) % len(h)]]
            dh, dv = _distance(x[h], point), _distance(x[v], point)
            radius = int(np.median(dh))
            if 0 < (inside := dh <= radius).sum() < len(h):
                todo.append((h[inside], v[dv - reach <= radius], depth + 1))
                todo.append((h[~inside], v[dv + reach > radius], depth + 1))
                continue
        for i in range(0, len(h), 1024):
            part = h[i : i + 1024]
            step = max(1, (1 << 20) // len(part))
            for j in range(0, len(v), step):
                a, b = np.nonzero(np.bitwise_count(x[v[j : j + step], None] ^ x[None, part]) <= reach)
                other = v[j + a] != part[b]
                if other.any():
                    unite(v[j + a[other]], part[b[other]])
    return x, parent


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def cells(fps: np.ndarray, tree: list[tuple[int, int]], reach: int, home_parts: np.ndarray, visitor_parts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(task, own fingerprints, those to compare them with besides)``: a leaf is a grid of its own parts by all parts, and two own parts meet once."""
    firsts = np.concatenate(([0], np.cumsum(home_parts * (home_parts + visitor_parts))))
    for leaf, home, visitors in route(fps, tree, reach):
        h, v = int(home_parts[leaf]), int(visitor_parts[leaf])
        at, of = _part(home, h), _part(visitors, v)
        for i in range(h):
            row, own = int(firsts[leaf]) + i * (h + v), home[at == i]
            for j in range(i, h):
                yield row + j, own, home[at == j] if i != j else home[:0]
            for j in range(v):
                come = visitors[of == j]
                if len(own) or len(come):
                    yield row + h + j, own, come


def stars(fps: DataFrame, total: int, reach: int, leaf_size: int | None = None) -> DataFrame:
    """``fp, star`` for each fingerprint with a link; ``fps`` holds ``total`` distinct ones.

    A leaf is a grid of tasks: its own fingerprints in parts, and its visitors in parts; each cell compares one of
    the own with one of either, so what a task holds stays bounded however many visitors come.
    """
    size = leaf_size or LEAF
    leaves = max(1, -(-total // size))
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(min(MAX_SAMPLE, SAMPLE_PER_LEAF * leaves)).collect()], np.int64).view(np.uint64)
    tree = build_tree(sample, leaves)
    home_parts, visitor_parts = task_parts(sample, tree, reach, total, size)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b["fp"].to_numpy().view(np.uint64) for b in batches]
        out = [(k, B.dump(x, y)) for k, x, y in cells(np.concatenate(got), tree, reach, home_parts, visitor_parts)] if got else []
        for i in range(0, len(out), 1024):
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out[i : i + 1024]], pa.int64()), pa.array([d for _, d in out[i : i + 1024]], pa.binary())], names=["task", "data"])

    def find(table: pa.Table) -> pa.Table:
        parts = [B.load(d, "u8", "u8") for d in table.column("data").to_pylist()]
        home, visitors = (np.sort(np.concatenate([p[i] for p in parts])) for i in (0, 1))
        x, root = linked(home, visitors, reach)
        in_link = np.bincount(root, minlength=len(x))[root] > 1
        # a star is named by its first fingerprint and the task
        task = table.column("task")[0].as_py()
        return pa.table({"fp": pa.array(x[in_link].view(np.int64)), "star": pa.array((task << 32) + root[in_link].astype(np.int64)), "lead": pa.array(x[root[in_link]].view(np.int64))})

    return fps.mapInArrow(deal, "task long, data binary").groupBy("task").applyInArrow(find, "fp long, star long, lead long")


# --- components --------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable over ``edges(u, v)``, for each node of an edge.

    Labels spread by minimum over the edges and then jump to their own label, which doubles
    what a round covers of a path whose labels rise along it (40 nodes take 6 rounds); each round is saved.
    """
    both = B.tabled(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = B.tabled(both.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("root", "near").alias("next"), "root")
        jump = spread.join(spread.select(F.col("node").alias("next"), F.col("next").alias("far")), "next", "left")
        new = B.tabled(jump.select("node", F.least("next", F.coalesce("far", "next")).alias("next"), "root"))
        labels = new.select("node", F.col("next").alias("root"))
        if new.where("next < root").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, *, width: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for each row: fingerprints that differ in at most ``max_bits`` bits are linked,
    and the component's id is its smallest ``doc_id``.

    Null or empty text: fingerprint zero, linked like any other. Null ``doc_id``: the
    row has a component like others, whose id is the smallest id that is not null.
    Repeated rows and ties share a fingerprint and so a component; a fingerprint that a third
    of all rows share counts once for each partition. Extra columns never
    matter. Empty table: no rows.
    """
    by_doc = B.tabled(fingerprints(docs, width))
    fps = B.tabled(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = B.saved(stars(fps.select("fp"), fps.count(), max_bits).where("fp <> lead").select(F.col("lead").alias("u"), F.col("fp").alias("v")).distinct())
    if links.isEmpty():
        known = fps.select("fp", F.col("first").alias("component_id"))
    else:
        of_fp = B.tabled(fps.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
        least = of_fp.groupBy("root").agg(F.min("first").alias("component_id"))
        known = of_fp.join(least, "root").select("fp", "component_id")
    return B.looked_up(by_doc, ["fp"], known).select("doc_id", "fp", "component_id")

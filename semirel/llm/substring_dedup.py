"""Exact removal of repeated byte strings by distributed suffix sorting.

A byte goes when it lies in a ``length``-byte string that also starts in a document
with a smaller ``doc_id``. Equal strings must meet to be compared, so each one is
dealt by the smallest hash among its 24-grams; neighbouring strings mostly share that
hash and travel together as one stretch of text. First the hashes alone are exchanged,
and only stretches whose hash occurs in two documents go on. Each bucket then sorts
its suffixes by deep-shallow sorting (``suffix_sort``) to the depth of a string: first
the stretches as they are, of which equal ones become one, and then, where different
stretches share a hash, every suffix within them. Runs of equals give the smallest
document of each string, which goes back to the blocks.

A hash that many documents share (what surrounds a common passage differs in each of
them) would load one bucket; its strings are dealt one by one by their own hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from semirel.llm import blocks as B
from semirel.llm.suffix_sort import deep_shallow

LENGTH, GRAM, SLICE, LONGEST, HOT_DOCS, BLOCK_BYTES, AT_ONCE, SPARE_BITS = 50, 24, 1 << 16, 256, 512, 4 << 20, 100_000, 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes the smallest hash of its grams."""
    h, base = _BYTE[data], np.uint64(0x9E3779B97F4A7C15)
    for span in (1, 2, 4):
        one = h[:-span] * base
        one += h[span:]
        h, base = one, base * base
    one = h[:-8] * base
    one += h[8:]
    h = h[16:] + one[:-8] * base  # three runs of eight bytes
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h &= np.uint64((1 << 64) - (1 << SPARE_BITS))  # fewer bits to send; equal keys of different strings are told apart later
    width, need = 1, length - GRAM + 1
    while 2 * width <= need:
        h, width = np.minimum(h[:-width], h[width:]), 2 * width
    return np.minimum(h[: len(h) - (need - width)], h[need - width :]) if need > width else h


@dataclass
class Stretches:
    """Runs of windows with one key: where each begins in the block, its windows, its key and its row."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    row: np.ndarray


def stretches(data: np.ndarray, ends: np.ndarray, length: int) -> Stretches:
    parts: list[tuple[np.ndarray, ...]] = []
    n, old = len(data) - length + 1, np.seterr(over="ignore")
    for a in range(0, max(n, 0), SLICE):
        m = min(SLICE, n - a)
        keys = _window_keys(data[a : a + m + length - 1], length)
        whole = np.ones(m, bool)  # does not reach into the next document
        for end in ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, a + m + length)].tolist():
            whole[max(0, end - length + 1 - a) : max(0, end - a)] = False
        new = np.ones(m, bool)
        new[1:] = (keys[1:] != keys[:-1]) | ~whole[:-1]
        first = np.flatnonzero(new & whole)
        stop = np.append(np.flatnonzero(new | ~whole), m)
        size = stop[np.searchsorted(stop, first, side="right")] - first
        if (size > LONGEST).any():
            times = -(-size // LONGEST)
            offset = (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) * LONGEST
            first, size = np.repeat(first, times) + offset, np.minimum(np.repeat(size, times) - offset, LONGEST)
        parts.append((first + a, size, keys[first], np.searchsorted(ends, first + a, side="right")))
    np.seterr(**old)
    if not parts:
        return Stretches(*(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64)))
    return Stretches(*(np.concatenate(x) for x in zip(*parts, strict=True)))


@dataclass
class Held:
    """A block's text, its stretches, and their keys with the number of documents that hold each."""

    text: bytes
    ends: np.ndarray
    ids: np.ndarray
    found: Stretches
    keys: np.ndarray
    docs: np.ndarray
    of: np.ndarray


def _hold(table: pa.Table, length: int) -> Held:
    texts, ids = B.texts_of(table), B.ids_of(table)
    text, ends = b"".join(texts), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    found = stretches(np.frombuffer(text, np.uint8), ends, length)
    keys, of = np.unique(found.key, return_inverse=True)
    doc = np.unique(ids, return_inverse=True)[1]
    pairs = np.unique(of * len(ids) + doc[found.row]) // max(1, len(ids))
    return Held(text, ends, ids, found, keys, np.bincount(pairs, minlength=len(keys)), of)


def _distinct(held: Held, n: int, got: dict[int, bytes], length: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings to compare with their keys, sorted by key; and for each occurrence its string, its place and its row."""
    several, hot = np.zeros(len(held.keys), bool), np.zeros(len(held.keys), bool)
    bounds = B.bucket_bounds(held.keys, n)
    for k, data in got.items():
        i, j = bounds[k], bounds[k + 1]
        for bits, target in zip(B.load(data, "u1", "u1"), (several, hot), strict=True):
            target[i:j] = np.unpackbits(bits, count=j - i)
    pick = np.flatnonzero(several[held.of])
    seen: dict[bytes, int] = {}
    keys: list[int] = []
    strings, places, rows = [], [], []
    text, digest, start, count, key, row, alone = held.text, xxhash.xxh64_intdigest, *(x[pick].tolist() for x in (held.found.start, held.found.count, held.found.key, held.found.row)), hot[held.of[pick]].tolist()
    for s, c, k, r, single in zip(start, count, key, row, alone, strict=True):
        for at, size in [(s + i, length) for i in range(c)] if single else [(s, c + length - 1)]:
            string = text[at : at + size]
            i = seen.setdefault(string, len(keys))
            if i == len(keys):
                keys.append(digest(string, 1) if single else k)
            strings.append(i)
            places.append(at)
            rows.append(r)
    by_key = np.argsort(np.array(keys, np.uint64), kind="stable")
    place = np.empty(len(keys), np.int64)
    place[by_key] = np.arange(len(keys))
    listed = list(seen)
    return [listed[i] for i in by_key.tolist()], np.array(keys, np.uint64)[by_key], place[np.array(strings, np.int64)], np.array(places, np.int64), np.array(rows, np.int64)


def _runs(text: bytes, start: np.ndarray, windows: np.ndarray, least: np.ndarray, some: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs ``stretch, from, to, smallest document`` of windows of the stretches ``some``, whose every suffix is sorted."""
    counts = windows[some]
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    owner = np.repeat(some, counts)
    order, group = deep_shallow(text, start[owner] + inside, length)
    smallest = np.full(int(group[-1]) + 1, B.LAST_ID)
    np.minimum.at(smallest, group, least[owner[order]])
    lowest = np.empty(len(order), np.int64)
    lowest[order] = smallest[group]
    cut = np.ones(len(lowest), bool)
    cut[1:] = (np.diff(owner) != 0) | (np.diff(lowest) != 0)
    first = np.flatnonzero(cut)
    last = np.append(first, len(lowest))[1:]
    return owner[first], inside[first], inside[last - 1] + 1, lowest[first]


def _compare(payloads: list[bytes], length: int) -> list[bytes | None]:
    """For each block's strings the stretches of windows whose smallest document is smaller than the block's largest."""
    asked = [B.load(x, "u8", "i4", "i8", "i8", "bytes") for x in payloads]
    sizes = [len(a[0]) for a in asked]
    key = np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked])
    size, low, high = (np.concatenate([a[i] for a in asked]).astype(np.int64) for i in (1, 2, 3))
    text = b"".join(a[4] for a in asked)
    start = np.cumsum(size) - size
    # the stretches themselves: equal ones become one
    order, group = deep_shallow(text, start, size)
    of = np.empty(len(order), np.int64)
    of[order] = group
    n = int(group[-1]) + 1 if len(group) else 0
    least = np.full(n, B.LAST_ID)
    np.minimum.at(least, of, low)
    one = np.zeros(n, np.int64)
    one[of] = np.arange(len(of))
    # where different stretches share a key: all suffixes of full depth in them, some keys at a time
    _, share, times = np.unique(key[one], return_inverse=True, return_counts=True)
    windows = size[one] - length + 1
    simple = np.flatnonzero(times[share] == 1)
    found = [(simple, np.zeros(len(simple), np.int64), windows[simple], least[simple])]
    mixed = np.flatnonzero(times[share] > 1)
    mixed = mixed[np.argsort(share[mixed], kind="stable")]
    ends = np.flatnonzero(np.diff(share[mixed], append=-1)) + 1  # of each key
    upto, done = np.cumsum(windows[mixed]), 0
    while done < len(mixed):
        fit = np.searchsorted(upto[ends - 1], (upto[done - 1] if done else 0) + AT_ONCE, side="right")  # keys that fit
        stop = int(ends[max(fit - 1, np.searchsorted(ends, done, side="right"))])
        found.append(_runs(text, start[one], windows, least, mixed[done:stop], length))
        done = stop
    run_of, *runs = (np.concatenate(x) for x in zip(*found, strict=True))
    runs = np.stack(runs)
    by = np.argsort(run_of, kind="stable")
    run_of, runs = run_of[by], runs[:, by]
    begin, total = np.searchsorted(run_of, np.arange(n)), np.bincount(run_of, minlength=n)
    out: list[bytes | None] = []
    at = 0
    for m in sizes:
        mine = of[at : at + m]
        k = total[mine]
        which = np.repeat(np.arange(m), k)
        pick = np.repeat(begin[mine], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        keep = runs[2, pick] < high[at : at + m][which]
        which, pick = which[keep], pick[keep]
        out.append(B.dump(which.astype(np.int32), runs[0, pick].astype(np.int32), runs[1, pick].astype(np.int32), runs[2, pick]) if len(pick) else None)
        at += m
    return out


def substring_dedup(docs: DataFrame, *, length: int = LENGTH, hot_docs: int = HOT_DOCS) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans`` for each row; ``kept`` are the remaining bytes (UTF-8 may be cut).

    Texts count as UTF-8 bytes, null as empty; matches never cross documents, overlaps
    count, and strings are judged on the input. Null ``doc_id``: orders after all others.
    Rows that repeat a ``doc_id`` never remove each other's bytes (no smaller id). Texts
    shorter than ``length`` stay whole; an empty table gives no rows; extra columns never matter.
    """
    if length < GRAM:
        raise ValueError(f"strings of at least {GRAM} bytes are compared")
    blocks = B.make_blocks(B.id_and_text(docs), BLOCK_BYTES)
    n = B.bucket_count(blocks, weight=8.0)  # sorting holds each suffix's numbers besides its text

    def ask(_: int, table: pa.Table) -> Iterator[tuple[int, bytes]]:
        held = _hold(table, length)
        bounds = B.bucket_bounds(held.keys, n)
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[k], bounds[k + 1])
            yield k, B.dump(B.key_planes(held.keys[part], SPARE_BITS), np.minimum(held.docs[part], 65535).astype(np.uint16))

    def count(_: int, which: list[int], payloads: list[bytes]) -> list[tuple[int, bytes]]:
        asked = [(B.keys_of_planes(a, SPARE_BITS), b) for a, b in (B.load(x, "u1", "u2") for x in payloads)]
        keys = np.concatenate([a[0] for a in asked])
        _, of = np.unique(keys, return_inverse=True)
        held = np.bincount(of, np.concatenate([a[1] for a in asked]))[of]
        out, at = [], 0
        for block, a in zip(which, asked, strict=True):
            mine = held[at : at + len(a[0])]
            at += len(a[0])
            if (mine > 1).any():
                out.append((block, B.dump(np.packbits(mine > 1), np.packbits(mine > hot_docs))))
        return out

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        block, held = left.column("block")[0].as_py(), _hold(B.unpack(left.column("data")[0].as_buffer()), length)
        got = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True))
        strings, keys, of, _, rows = _distinct(held, n, got, length)
        low, high = np.full(len(strings), B.LAST_ID), np.full(len(strings), -B.LAST_ID)
        np.minimum.at(low, of, held.ids[rows])
        np.maximum.at(high, of, held.ids[rows])
        bounds, out = B.bucket_bounds(keys, n), []
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            i, j = bounds[k], bounds[k + 1]
            out.append((block, k, B.dump(B.gaps(keys[i:j]), np.fromiter(map(len, strings[i:j]), np.int32, j - i), low[i:j], high[i:j], b"".join(strings[i:j]), text=True)))
        del held, strings
        B.relax()
        return B.answers(out)

    def compare(_: int, which: list[int], payloads: list[bytes]) -> list[tuple[int, bytes]]:
        return [(b, x) for b, x in zip(which, _compare(payloads, length), strict=True) if x]

    shared = B.saved(B.resolve(B.emit(blocks, ask), count))
    sent = blocks.select("block", "data").groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, B.ANSWER_SCHEMA)
    smallest = B.resolve(sent, compare)

    def finish(_: int, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        held = _hold(table, length)
        _, keys, of, places, rows = _distinct(held, n, {k: x for k, x in got.items() if k >= 0}, length)
        bounds = B.bucket_bounds(keys, n)
        runs = [(x[0] + bounds[-1 - k], *x[1:]) for k, data in got.items() if k < 0 for x in [B.load(data, "i4", "i4", "i4", "i8")]]
        change = np.zeros(len(held.text) + 1, np.int32)
        if runs:
            string, begin, end, least = (np.concatenate(x) for x in zip(*runs, strict=True))
            by = np.argsort(string, kind="stable")
            string, begin, end, least = string[by], begin[by], end[by], least[by]
            at, k = np.searchsorted(string, of), np.bincount(string, minlength=len(keys))[of]
            which = np.repeat(np.arange(len(of)), k)
            pick = np.repeat(at, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            gone = least[pick] < held.ids[rows[which]]
            which, pick = which[gone], pick[gone]
            np.add.at(change, places[which] + begin[pick], 1)
            np.add.at(change, places[which] + end[pick] + length - 1, -1)
        covered = np.cumsum(change[:-1]) > 0
        rises = covered.copy()
        rises[1:] &= ~covered[:-1]
        starts = np.concatenate(([0], held.ends[:-1])).astype(np.int64)
        inner = starts[(starts < len(covered))]
        rises[inner] = covered[inner]
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate((starts, held.ends[-1:]))])
        data = np.frombuffer(held.text, np.uint8)
        kept = [data[i:j][~covered[i:j]].tobytes() for i, j in zip(starts.tolist(), held.ends.tolist(), strict=True)]
        return pa.table({"doc_id": table.column("doc_id"), "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(held.ends - starts, pa.int64()), "n_removed": pa.array(total(covered), pa.int64()), "n_spans": pa.array(total(rises), pa.int64())})

    back = shared.unionByName(smallest.selectExpr("block", "-1 - bucket AS bucket", "data"))
    return B.settle(blocks, back, finish, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")

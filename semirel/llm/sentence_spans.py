"""Substring dedup by sliding sentence spans.

Every run of at least ``span`` consecutive sentences and ``min_words`` words counts; the
sentences under any occurrence but the first (by document, then by place) go. Only the
shortest such run from each start and the shortest one to each end are hashed and joined
across the corpus: a repeated run is covered by those within it, which repeat as it does.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from semirel.llm import blocks as B

SPAN, MIN_WORDS = 2, 12
_BREAK = re.compile(rb"[.!?]+\s+|\n\s*")


def sentences(text: bytes) -> list[tuple[int, int]]:
    """``(start, end)`` of each sentence with the white space after it; together they are the whole text."""
    cuts = [0, *(m.end() for m in _BREAK.finditer(text))]
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return list(zip(cuts, cuts[1:], strict=False))


def shortest_runs(sizes: list[int], span: int, least: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the shortest runs of at least ``span`` sentences and ``least`` words from each start and to each end."""
    total, n = [0, *accumulate(sizes)], len(sizes)
    forward = {(p, max(p + span, bisect_left(total, total[p] + least))) for p in range(n - span + 1)}
    backward = {(min(e - span, bisect_right(total, total[e] - least) - 1), e) for e in range(span, n + 1)}
    return sorted((p, e) for p, e in forward | backward if p >= 0 and e <= n)


def _spans(text: bytes, span: int, least: int) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int, bytes]]]:
    """The sentences, which of them hold words, and ``(start and end among those, digest)`` of each shortest run."""
    cuts = sentences(text)
    words = [text[i:j].lower().split() for i, j in cuts]
    full = [i for i, w in enumerate(words) if w]
    keys = [b" ".join(words[i]) for i in full]
    runs = shortest_runs([len(words[i]) for i in full], span, least)
    digest = xxhash.xxh3_128_digest
    return cuts, full, [(p, e, digest(b"\n".join(keys[p:e]))[:12]) for p, e in runs]


def _collect(table: pa.Table, span: int, least: int):
    """Per document its id, text, sentences and spans; and the block's sorted span keys with their first occurrence."""
    seen: dict[bytes, int] = {}
    first: list[tuple[int, int]] = []
    rows = []
    for doc, text in zip(B.ids_of(table).tolist(), B.texts_of(table), strict=True):
        cuts, full, found = _spans(text, span, least)
        at = []
        for p, e, key in found:
            i = seen.setdefault(key, len(first))
            if i == len(first):
                first.append((doc, p))
            elif (doc, p) < first[i]:
                first[i] = (doc, p)
            at.append((p, e, i))
        rows.append((doc, text, cuts, full, at))
    raw = np.frombuffer(b"".join(seen), np.dtype([("hi", ">u8"), ("lo", ">u4")]))
    hi, lo = raw["hi"].astype(np.uint64), raw["lo"].astype(np.uint32)
    order = np.lexsort((lo, hi))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc, at = (np.array([f[i] for f in first], np.int64)[order] for i in (0, 1))
    return rows, place, hi[order], lo[order], doc, at


def _first(which: list[int], payloads: list[bytes]) -> list[tuple[int, bytes]]:
    asked = [B.load(x, "u8", "u4", "i8", "i4") for x in payloads]
    hi = np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked])
    lo, doc, at = (np.concatenate([a[i] for a in asked]) for i in (1, 2, 3))
    order = np.lexsort((at, doc, lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(hi[order]) != 0) | (np.diff(lo[order].astype(np.int64)) != 0)
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out, i = [], 0
    for block, a in zip(which, asked, strict=True):
        mine = lead[i : i + len(a[0])]
        earlier = np.flatnonzero((doc[mine] != a[2]) | (at[mine] != a[3]))
        if len(earlier):
            out.append((block, B.dump(earlier.astype(np.int32), doc[mine[earlier]], at[mine[earlier]])))
        i += len(a[0])
    return out


def span_dedup(docs: DataFrame, *, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text, n_sentences, n_removed, n_spans`` for each row.

    A sentence ends at ``.``, ``!`` or ``?`` before white space, or at a line's end; it is
    compared in lower case (A-Z) with its white space as single spaces. Short sentences count
    together with their neighbours; repeats of under ``min_words`` words in all, or of fewer
    than ``span`` sentences, are left alone. ``n_spans`` counts the runs of removed sentences.

    Null or empty text: no sentence. A text of fewer than ``span`` sentences stays.
    Null ``doc_id`` orders after all others. Rows that repeat a ``doc_id`` count as one
    document: of equal passages at equal places none is before the other, so both stay.
    Extra columns never matter. Empty table: no rows.
    """
    blocks = B.make_blocks(B.id_and_text(docs))
    n = B.bucket_count(blocks)

    def ask(_: int, table: pa.Table) -> Iterator[tuple[int, bytes]]:
        _, _, hi, lo, doc, at = _collect(table, span, min_words)
        bounds = B.bucket_bounds(hi, n)
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[k], bounds[k + 1])
            yield k, B.dump(B.gaps(hi[part]), lo[part], doc[part], at[part].astype(np.int32))

    def finish(_: int, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        rows, place, hi, _, doc, at = _collect(table, span, min_words)
        bounds = B.bucket_bounds(hi, n)
        for k, data in got.items():
            i, d, p = B.load(data, "i4", "i8", "i4")
            doc[bounds[k] + i], at[bounds[k] + i] = d, p
        doc, at = doc[place].tolist(), at[place].tolist()
        texts, total, removed, runs = [], [], [], []
        for own, text, cuts, full, found in rows:
            gone = {full[q] for p, e, i in found if (own, p) != (doc[i], at[i]) for q in range(p, e)}
            texts.append(b"".join(text[a:b] for i, (a, b) in enumerate(cuts) if i not in gone) if gone else text)
            total.append(len(full))
            removed.append(len(gone))
            rank = {i: r for r, i in enumerate(full)} if gone else {}
            ranks = sorted(rank[i] for i in gone)
            runs.append(sum(1 for j, r in enumerate(ranks) if not j or r != ranks[j - 1] + 1))
        counts = {name: pa.array(x, pa.int64()) for name, x in (("n_sentences", total), ("n_removed", removed), ("n_spans", runs))}
        return pa.table({"doc_id": table.column("doc_id"), "text": pa.array(texts, pa.binary()).cast(pa.string()), **counts})

    answered = B.resolve(B.emit(blocks, ask), lambda _, which, payloads: _first(which, payloads))
    return B.settle(blocks, answered, finish, "doc_id long, text string, n_sentences long, n_removed long, n_spans long")

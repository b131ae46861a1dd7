"""Document probability under a subword unigram model, over all segmentations.

The vocabulary is an existing one: the pieces of a public byte-level vocabulary. A
piece's first score falls with its place in the vocabulary; expectation maximisation
over the words of all training documents, each as often as it occurs, then fits the scores to the corpus.
A word's probability is the sum over every way through its lattice (forward recursion
in log space). As no piece spans two words, a document's probability is the product over
its words, times that of its end. ``mixed_score`` adds one edge across each whole word that
training has seen, with its discounted frequency; ``score`` is that of the lattice alone.

A word's lattice is computed once in the corpus, in the bucket that holds the word,
and not once for each time it is read.
"""

from __future__ import annotations

import base64
import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirel.llm import blocks as B

EM_ROUNDS, PRIOR, BATCH, LONG_WORD = 3, 0.1, 16384, 40
LN10 = math.log(10)


class Lattice:
    """The usable pieces of a vocabulary: those a lower-cased word with a leading space can hold."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.id = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.opens = np.array([p[:1] == b" " for p in pieces])
        self.base = np.uint64(0x9E3779B97F4A7C15)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.bits = 20
        self.keys, self.ids, self.probes = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0
        for i, h in enumerate(hashes.tolist()):
            slot, n = self._slot(np.uint64(h)), 1
            while self.keys[slot]:
                slot, n = (slot + 1) & ((1 << self.bits) - 1), n + 1
            self.keys[slot], self.ids[slot], self.probes = h, i, max(self.probes, n)

    def _hash(self, piece: bytes) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.base) + c + 1) & ((1 << 64) - 1)
        return h

    def _slot(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows hold a piece, and its id."""
        slot = self._slot(h)
        there = self.keys[slot]
        rows = np.flatnonzero(there)
        out_rows, out_ids = [], []
        for _ in range(self.probes):
            if not len(rows):
                break
            hit = there[rows] == h[rows]
            out_rows.append(rows[hit])
            out_ids.append(self.ids[slot[rows[hit]]])
            rows = rows[~hit]
            slot[rows] = (slot[rows] + 1) & ((1 << self.bits) - 1)
            there[rows] = self.keys[slot[rows]]
            rows = rows[there[rows] != 0]
        return (np.concatenate(out_rows), np.concatenate(out_ids)) if out_rows else (np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _edges(self, chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(from, to, rows, piece ids)`` for words of one length, by growing ``from``."""
        n = chars.shape[1]
        with np.errstate(over="ignore"):
            for i in range(n):
                h = np.zeros(len(chars), np.uint64)
                for j in range(i, min(n, i + self.longest)):
                    h = h * self.base + chars[:, j]
                    rows, ids = self._find(h)
                    if len(rows):
                        yield i, j + 1, rows, ids

    def _batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes[sizes < LONG_WORD]).tolist():
            which = np.flatnonzero(sizes == size)
            for i in range(0, len(which), BATCH):
                rows = which[i : i + BATCH]
                raw = np.frombuffer(b"".join(b" " + words[r] for r in rows.tolist()), np.uint8).reshape(len(rows), size + 1)
                yield rows, raw.astype(np.uint64) + np.uint64(1)

    def _long(self, word: bytes, scores: np.ndarray) -> list[list[tuple[int, int]]]:
        text = b" " + word
        edges: list[list[tuple[int, int]]] = []
        for i in range(len(text)):
            edges.append([(j, k) for j in range(i + 1, min(len(text), i + self.longest) + 1) if (k := self.id.get(text[i:j])) is not None])
        return edges

    def log_likelihood(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability, summed over its segmentations."""
        out = np.full(len(words), -np.inf)
        for rows, chars in self._batches(words):
            alpha = np.full((chars.shape[1] + 1, len(rows)), -np.inf)
            alpha[0] = 0
            for i, j, r, k in self._edges(chars):
                alpha[j, r] = np.logaddexp(alpha[j, r], alpha[i, r] + scores[k])
            out[rows] = alpha[-1]
        for r, word in enumerate(words):
            if len(word) >= LONG_WORD:
                out[r] = self._forward(self._long(word, scores), scores)[-1]
        return out

    @staticmethod
    def _forward(edges: list[list[tuple[int, int]]], scores: np.ndarray) -> list[float]:
        alpha = [-math.inf] * (len(edges) + 1)
        alpha[0] = 0.0
        for i, out in enumerate(edges):
            for j, k in out:
                x, y = alpha[j], alpha[i] + float(scores[k])
                alpha[j] = y if x == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
        return alpha

    def expected(self, words: list[bytes], counts: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How often each piece is expected in ``words`` taken ``counts`` times."""
        total = np.zeros(len(self.pieces))
        for rows, chars in self._batches(words):
            n = chars.shape[1]
            alpha, beta = np.full((n + 1, len(rows)), -np.inf), np.full((n + 1, len(rows)), -np.inf)
            alpha[0], beta[n] = 0, 0
            edges = list(self._edges(chars))
            for i, j, r, k in edges:
                alpha[j, r] = np.logaddexp(alpha[j, r], alpha[i, r] + scores[k])
            weight = counts[rows]
            for i, j, r, k in reversed(edges):
                onward = scores[k] + beta[j, r]
                beta[i, r] = np.logaddexp(beta[i, r], onward)
                total += np.bincount(k, weight[r] * np.exp(alpha[i, r] + onward - alpha[n, r]), minlength=len(total))
        for word, count in zip(words, counts.tolist(), strict=True):
            if len(word) >= LONG_WORD:
                edges = self._long(word, scores)
                alpha, beta = self._forward(edges, scores), [-math.inf] * len(edges) + [0.0]
                for i in range(len(edges) - 1, -1, -1):
                    for j, k in edges[i]:
                        y = float(scores[k]) + beta[j]
                        beta[i] = y if beta[i] == -math.inf else max(beta[i], y) + math.log1p(math.exp(-abs(beta[i] - y)))
                        total[k] += count * math.exp(alpha[i] + y - alpha[-1])
        return total


@functools.lru_cache(maxsize=2)
def lattice(ranks_path: str) -> Lattice:
    with open(ranks_path, "rb") as f:
        ranked = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
    usable = lambda p: p == p.lower() and (len(p) == 1 or not p[1:] or len(p[1:].split()) == 1 and p[1:].split()[0] == p[1:]) and (p[:1] == b" " or p.split() == [p] or len(p) == 1)
    return Lattice([p for _, p in ranked if usable(p)])


def first_scores(size: int) -> np.ndarray:
    """By place in the vocabulary, as word frequencies fall with their rank."""
    p = 1 / (np.arange(size) + 10.0)
    return np.log(p / p.sum())


def normal_scores(times: np.ndarray, opens: np.ndarray, words: float) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces that open a word, of those that go on, and of stopping."""
    on = times[~opens].sum() + words
    return np.log(np.where(opens, times / times[opens].sum(), times / on)), math.log(words / on)


def discount(once: float, twice: float) -> float:
    """Absolute discount from how many words are seen once and twice."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once and twice else 0.75


def default_path() -> str:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken")


def is_held_out(doc: int, part: int = 2, parts: int = 7) -> bool:
    """By crc32 of the id as text; a null id is never held out."""
    return doc != B.LAST_ID and zlib.crc32(str(doc).encode()) % parts == part


def _tokens(table: pa.Table, learn: bool) -> tuple[list[tuple[int, list[bytes]]], list[bytes], np.ndarray, np.ndarray]:
    """Each document's words; and the block's distinct words by hash, with their hashes and, to ``learn``, training counts."""
    rows, learned, seen = [], Counter(), set()
    for doc, text in zip(B.ids_of(table).tolist(), B.texts_of(table), strict=True):
        words = text.lower().split()
        rows.append((doc, words))
        (learned if learn and not is_held_out(doc) else seen).update(words)
    seen.update(learned)
    hashed = sorted(zip(map(xxhash.xxh64_intdigest, seen), seen, strict=True))
    words = [w for _, w in hashed]
    return rows, words, np.array([h for h, _ in hashed], np.uint64), np.array([learned[w] for w in words], np.int64) if learn else np.zeros(0, np.int64)


def score_documents(docs: DataFrame, ranks_path: str | None = None, *, em_rounds: int = EM_ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score`` for each row, learning from those not held out.

    Texts in lower case (A-Z) are words between ASCII white space, and one end. ``base_score``
    is the add-one word unigram, ``score`` the base-10 logarithm of the marginal probability.
    Null or empty text: the end alone. Null ``doc_id``: learned from. Repeated rows count
    each. Very long words take time in proportion to their length. Empty table: no rows.
    """
    path = ranks_path or default_path()
    spark = docs.sparkSession
    blocks = B.make_blocks(B.id_and_text(docs))
    n = B.bucket_count(blocks)

    def ask(_: int, table: pa.Table) -> Iterator[tuple[int, bytes]]:
        _, words, hashes, counts = _tokens(table, True)
        bounds = B.bucket_bounds(hashes, n)
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[k], bounds[k + 1])
            yield k, B.dump(b"\n".join(words[part]), counts[part])

    def merge(_: int, __: list[int], payloads: list[bytes]) -> list[tuple[int, bytes]]:
        total: dict[bytes, int] = {}
        for data in payloads:
            words, counts = B.load(data, "bytes", "i8")
            for w, c in zip(words.split(b"\n"), counts.tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        return [(-1, B.dump(b"\n".join(total), np.array(list(total.values()), np.int64)))]

    asked = B.saved(B.emit(blocks, ask))
    vocabulary = B.saved(B.resolve(asked, merge))
    doc_id = F.col("doc_id")
    kept_out = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))
    train_docs = B.id_and_text(docs).where(~kept_out).count()

    # --- fit: sums over pieces only, so what comes back is bounded by the vocabulary
    def expect(scores: np.ndarray | None):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, total, seen = lattice(path), None, np.zeros(4)
            for batch in batches:
                for data in batch["data"]:
                    words, counts = B.load(data.as_buffer(), "bytes", "i8")
                    some = np.flatnonzero(counts)
                    listed = words.split(b"\n")
                    listed = [listed[i] for i in some.tolist()]
                    seen += (counts.sum(), len(some), (counts == 1).sum(), (counts == 2).sum())
                    part = model.expected(listed, counts[some].astype(np.float64), scores if scores is not None else first_scores(len(model.pieces)))
                    total = part if total is None else total + part
            if total is not None:
                ids = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([-1, -2, -3, -4, *ids.tolist()], pa.int32()), pa.array([*seen.tolist(), *total[ids].tolist()], pa.float64())], names=["piece", "times"])

        return run

    scores, model = None, lattice(path)
    for _ in range(max(1, em_rounds)):
        got = {r[0]: r[1] for r in vocabulary.select("data").mapInArrow(expect(scores), "piece int, times double").groupBy("piece").agg(F.sum("times")).collect()}
        word_tokens, word_kinds, once, twice = (round(got.pop(-k, 0.0)) for k in (1, 2, 3, 4))
        times = np.full(len(model.pieces), PRIOR)
        for k, x in got.items():
            times[k] += x
        scores, stop = normal_scores(times, model.opens, word_tokens + PRIOR)
    train_tokens, kinds = word_tokens + train_docs, word_kinds + int(train_docs > 0)
    cut, mass = discount(once, twice), train_tokens + 2 * PRIOR
    going = math.log((word_tokens + PRIOR) / mass)  # that another word comes and not the end
    end_score, rest = math.log((train_docs + PRIOR) / mass), math.log((cut * word_kinds + PRIOR) / mass)
    shared = spark.sparkContext.broadcast((scores, stop, rest))  # one number for each piece of the vocabulary

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        words, counts = B.load(right.column("data")[0].as_buffer(), "bytes", "i8")
        listed = words.split(b"\n")
        place = {w: i for i, w in enumerate(listed)}
        scores, stop, rest = shared.value
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(counts - cut, 0) / mass)
        inside = lattice(path).log_likelihood(listed, scores) + stop
        logs, mixed = inside + going, np.logaddexp(whole, inside + rest)
        bucket = right.column("bucket")[0].as_py()
        out = []
        for block, data in zip(left.column("block").to_pylist(), left.column("data").to_pylist(), strict=True):
            at = np.array([place[w] for w in B.load(data, "bytes", "i8")[0].split(b"\n")], np.int64)
            out.append((block, bucket, B.dump(counts[at], logs[at], mixed[at])))
        B.relax()
        return B.answers(out)

    answered = asked.select("bucket", "block", "data").groupBy("bucket").cogroup(vocabulary.groupBy("bucket")).applyInArrow(weigh, B.ANSWER_SCHEMA)

    def finish(_: int, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        rows, words, _, _ = _tokens(table, False)
        counts, logs, mixed = (np.concatenate(x) for x in zip(*(B.load(got[k], "i8", "f8", "f8") for k in sorted(got)), strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        place = {w: i for i, w in enumerate(words)}
        weights = np.log10(counts + 1.0)
        shift, end = math.log10(train_tokens + kinds + 1), math.log10(train_docs + 1)
        out: list[tuple] = []
        for doc, listed in rows:
            at = np.fromiter(map(place.__getitem__, listed), np.int64, len(listed))
            size = len(listed) + 1
            out.append((is_held_out(doc), size, int((counts[at] > 0).sum()) + int(train_docs > 0), train_tokens, float(weights[at].sum()) + end - size * shift, *((float(x[at].sum()) + end_score) / LN10 for x in (logs, mixed))))
        columns = list(zip(*out, strict=True))
        kinds_ = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table({"doc_id": table.column("doc_id"), **{name: pa.array(c, t) for name, c, t in zip(("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score"), columns, kinds_, strict=True)}})

    return B.settle(blocks, answered, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixed_score double")

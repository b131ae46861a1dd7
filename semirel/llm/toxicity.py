"""A toxicity classifier that is regularised by counterfactuals.

A logistic model over hashed words, repeated words and word beginnings is fitted on a bounded sample
of labelled documents. Each labelled sentence that holds an identity term is also
taken with the term swapped for others of its kind, and the change of the sentence's
score is penalised: the higher of the two scores is pulled down to the lower one, so
that the mention of a group tells as little as that of the most neutral one. The weights (a fixed number of them) are then sent to all
executors, and every whole text is scored there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semirel.llm import blocks as B

BITS, MAX_LABELLED, EPOCHS, L2, SWAP_PENALTY, THRESHOLD = 20, 8_000, 60, 2e-4, 1.0, 0.7
MAX_MENTIONS = 20_000
#: A feature takes part from this chi-square on, between its presence and the label.
LEAST_CHI2 = 15.0
BEGINNINGS = (4, 5, 6, 7)
CACHE = 1 << 17

#: Terms that name groups of people, by kind. A term is swapped for those of its own kind.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "gender": ("women", "men", "girls", "boys", "woman", "man", "female", "male", "transgender", "nonbinary"),
    "religion": ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "muslim", "christian", "jewish", "hindu", "buddhist"),
    "origin": ("immigrants", "refugees", "foreigners", "natives", "africans", "asians", "europeans", "americans", "mexicans", "arabs"),
    "colour": ("black", "white", "brown", "asian", "latino", "hispanic", "indigenous"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    "age": ("elderly", "young", "old", "teenagers", "children", "adults"),
    "ability": ("disabled", "blind", "deaf", "autistic", "paralyzed"),
}
_KIND = {term: kind for kind, terms in IDENTITY_TERMS.items() for term in terms}
_TERMS = {term: i for i, term in enumerate(_KIND)}
_EDGES = "\"'`.,;:!?()[]{}<>|*#%&$/\\-_+=~^"
_SENTENCE = re.compile(r"[.!?\n]+")


def words(text: str) -> dict[str, bool]:
    """The distinct words in lower case, without marks at their ends, and whether they stand there more than once."""
    out: dict[str, bool] = {}
    for x, n in Counter(text.lower().split()).items():
        if w := x.strip(_EDGES):
            out[w] = n > 1 or w in out
    return out


def features(word: str, bits: int = BITS) -> list[int]:
    """Places of the whole word and of its beginnings of 4 to 7 characters."""
    mask, digest = (1 << bits) - 1, xxhash.xxh32_intdigest
    return [digest(word, 1) & mask, *(digest(word[:n], n) & mask for n in BEGINNINGS)]


def again(word: str, bits: int = BITS) -> int:
    """Place of the word as one that is repeated."""
    return xxhash.xxh32_intdigest(word, 2) & ((1 << bits) - 1)


def text_features(text: str, bits: int = BITS) -> np.ndarray:
    return np.unique(np.array([f for w, twice in words(text).items() for f in (*features(w, bits), *((again(w, bits),) if twice else ()))], np.int32))


def _swaps(text: str) -> Counter:
    """How often sentences hold a term of ``_TERMS`` and not the other of its kind: by the places of both and whether the term is repeated; as many keys as the term lists allow."""
    out: Counter = Counter()
    for _, changes in _mentions(text):
        out.update(changes)
    return out


def _mentions(text: str) -> Iterator[tuple[str, list[tuple[int, int, bool]]]]:
    """Each sentence that holds an identity term, and the swaps that it allows."""
    for sentence in _SENTENCE.split(text):
        held = words(sentence)
        changes = [(_TERMS[term], _TERMS[other], held[term]) for term in sorted(held.keys() & _KIND.keys()) for other in IDENTITY_TERMS[_KIND[term]] if other != term and other not in held]
        if changes:
            yield sentence, changes


def swap_features(term: str, other: str, repeated: bool, bits: int = BITS) -> tuple[list[int], list[int]]:
    """The features that a swap takes away and those that it brings."""
    return tuple(features(w, bits) + ([again(w, bits)] if repeated else []) for w in (term, other))


def identity_features(bits: int = BITS) -> np.ndarray:
    """The features of all identity terms, which always take part."""
    return np.unique([f for w in _KIND for f in (*features(w, bits), again(w, bits))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def associated(docs: list[np.ndarray], labels: np.ndarray, size: int, least: float = LEAST_CHI2) -> np.ndarray:
    """Which features' presence goes with the label, by the chi-square of the two-by-two table; what a single document has never does."""
    present, toxic = np.zeros(size), np.zeros(size)
    for d, y in zip(docs, labels, strict=True):
        present[d] += 1
        toxic[d] += y
    return _associated(present, toxic, len(docs), labels.sum(), least)


def _associated(present: np.ndarray, toxic: np.ndarray, n: float, n1: float, least: float = LEAST_CHI2) -> np.ndarray:
    apart = toxic * n - present * n1
    spread = present * (n - present) * n1 * (n - n1)
    return (present > 1) & (np.divide(n * apart * apart, spread, out=np.zeros(len(present)), where=spread > 0) >= least)


def _padded(lists: list, slot: np.ndarray, none: int) -> np.ndarray:
    """One row of slots for each list; ``none`` stands for what is not there."""
    out = np.full((len(lists), max(map(len, lists), default=0)), none, np.int64)
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = slot[np.asarray(x, np.int64)]
    return out


def fit(docs: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[list[int], list[int]]], *, bits: int = BITS, epochs: int = EPOCHS, l2: float = L2, penalty: float = SWAP_PENALTY, times: np.ndarray | None = None, mentions: list[tuple[np.ndarray, int, int]] | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the log loss plus the counterfactual penalty (Adam, fixed order).

    The penalty is ``penalty`` times the mean squared change of a sentence's score by a swap. ``mentions`` lists
    ``(the sentence's features, place in swaps, how often)``; without it each swap's terms are sentences by themselves,
    ``times`` often (once), and their logits are compared. It is one-sided: of the two scores only the higher one is
    pulled towards the other, so that a group which clean texts mention is never made to look toxic by another.

    Features that do not go with the label (``associated``) are left out, but never those that a swap moves: the
    documents that mention a group say themselves what its mention means.
    """
    n, size = len(docs), 1 << bits
    if not n or labels.min() == labels.max():
        return np.zeros(size), -6.0 if not n or labels.max() == 0 else 6.0
    rng = np.random.default_rng(7)
    docs = [np.unique(d) for d in docs]
    useful = associated(docs, labels, size)
    for pair in swaps:
        useful[pair[0]] = useful[pair[1]] = True
    active = np.flatnonzero(useful)
    k = len(active)
    slot = np.full(size, -1, np.int64)
    slot[active] = np.arange(k)
    docs = [slot[d[useful[d]]] for d in docs]
    out_, in_ = (_padded([s[i] for s in swaps], slot, k) for i in (0, 1))
    w, bias = np.zeros(k + 1), float(np.log(labels.mean() / (1 - labels.mean())))  # the last weight stays zero
    m, v = np.zeros(k + 2), np.zeros(k + 2)
    step, batch = 0, 256
    if mentions is not None:
        which, part = np.array([x[1] for x in mentions], np.int64), np.array([x[2] for x in mentions], float)
        held = [slot[np.unique(x[0])] for x in mentions]
        held = [x[x >= 0] for x in held]
        at, flat_held = np.repeat(np.arange(len(held)), [len(x) for x in held]), np.concatenate([np.zeros(0, np.int64), *held])
    else:
        which, part = np.arange(len(swaps)), np.ones(len(swaps)) if times is None else times
    part = part / max(part.sum(), 1)
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            rows = order[i : i + batch]
            flat = np.concatenate([docs[r] for r in rows])
            of = np.repeat(np.arange(len(rows)), [len(docs[r]) for r in rows])
            error = _sigmoid(np.bincount(of, w[flat], minlength=len(rows)) + bias) - labels[rows]
            grad = np.append(np.bincount(flat, error[of], minlength=k + 1) / len(rows) + l2 * w, error.mean())
            if len(which) and penalty:
                change = (w[in_].sum(axis=1) - w[out_].sum(axis=1))[which]
                if mentions is None:
                    pull = 2 * penalty * part * change
                else:
                    before = np.bincount(at, w[flat_held], minlength=len(held)) + bias
                    a, b = _sigmoid(before), _sigmoid(before + change)
                    higher = np.maximum(a, b)  # its slope; 16 makes a change of the score as heavy as one of the logit is at most
                    pull = 2 * 16 * penalty * part * (b - a) * higher * (1 - higher)
                up, down = (np.bincount(which, np.where(side, pull, 0), minlength=len(swaps)) for side in (change > 0, change < 0))
                grad[:-1] += np.bincount(in_.ravel(), np.repeat(up, in_.shape[1]), minlength=k + 1)
                grad[:-1] += np.bincount(out_.ravel(), np.repeat(-down, out_.shape[1]), minlength=k + 1)
                grad[k] = 0
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w -= move[:-1]
            w[k] = 0
            bias -= move[-1]
    whole = np.zeros(size)
    whole[active] = w[:-1]
    return whole, float(bias)


class Scorer:
    """Scores texts; what a word adds is kept, up to a bounded number of words."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int = BITS):
        self.weights, self.bias, self.bits, self.known = weights, bias, bits, {}

    def __call__(self, text: str) -> float:
        total, known = self.bias, self.known
        for word, twice in words(text).items():
            x = known.get(word)
            if x is None:
                if len(known) >= CACHE:
                    known.clear()
                w = self.weights
                x = known[word] = (float(w[features(word, self.bits)].sum()), float(w[again(word, self.bits)]))
            total += x[0] + x[1] if twice else x[0]
        return float(_sigmoid(np.float64(total)))


def held_out(doc_id: Column, part: int = 1, parts: int = 3) -> Column:
    """True where crc32 of the id as text leaves the remainder ``part``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, max_mentions: int = MAX_MENTIONS, bits: int = BITS, penalty: float = SWAP_PENALTY) -> Scorer:
    """Fit on at most ``max_labelled`` labelled documents, chosen by a hash of their ids, none of them held out.

    Their sentences that hold an identity term make the penalty: at most ``max_mentions`` different ones (after what is no
    feature has gone), chosen by a hash, each as often as it occurs. What reaches the driver is bounded by these two
    numbers and the features that go with the label; those are selected by counts over all documents of the sample first.

    A document labelled more than once counts as toxic if any label says so; of rows that repeat an id one text counts (by
    its hash); null ids, null labels and labels without a document are left out. With no labels, or with one class
    only, the score is a constant near that class (near 0 without labels).
    """
    marks = B.numbered(labels).select(F.col(f"c{labels.columns.index('doc_id')}").cast("long").alias("doc_id"), F.col(f"c{labels.columns.index('toxic')}").cast("int").alias("toxic"))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def each(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [(x or b"").decode() for x in b["text"].to_pylist()]
        found = [text_features(x, bits).tobytes() for x in texts]
        said = [[(text_features(x, bits).tobytes(), np.array(changes, np.int32).tobytes()) for x, changes in _mentions(t)] for t in texts]
        said = [[{"held": h, "changes": c} for h, c in x] for x in said]
        kind = pa.list_(pa.struct([("held", pa.binary()), ("changes", pa.binary())]))
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], b["hash"], pa.array(found, pa.binary()), pa.array(said, kind)], names=["doc_id", "toxic", "hash", "found", "said"])

    # the labels joined are at most max_labelled rows of two numbers, so they may be broadcast
    joined = B.id_and_text(docs).join(F.broadcast(marks), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("hash"), "text")
    joined = B.map_rows(joined, each, "doc_id long, toxic int, hash long, found binary, said array<struct<held:binary,changes:binary>>")
    rows = B.saved(joined.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "found", "said"), "hash").alias("r")).select("doc_id", "r.*"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, toxic = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for b in batches:
            for x, y in zip(b["found"], b["toxic"].to_pylist(), strict=True):
                x = np.frombuffer(x.as_buffer(), np.int32)
                present[x] += 1
                toxic[x] += y
        f = np.flatnonzero(present)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f, present[f], toxic[f])], names=["feature", "present", "toxic"])

    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = rows.select("found", "toxic").mapInArrow(count, "feature long, present long, toxic long").groupBy("feature").agg(F.sum("present").cast("double").alias("present"), F.sum("toxic").cast("double").alias("toxic"))
    apart, spread = F.col("toxic") * n - F.col("present") * n1, F.col("present") * (n - F.col("present")) * n1 * (n - n1)
    some = counts.where((F.col("present") > 1) & (n * apart * apart >= LEAST_CHI2 * spread) & (spread > 0)).select("feature").collect()
    useful = np.zeros(1 << bits, bool)
    useful[[r[0] for r in some]] = useful[identity_features(bits)] = True
    shared = docs.sparkSession.sparkContext.broadcast(useful)  # one flag for each place, whatever the corpus

    def select(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flags = shared.value
        less = lambda x: (f := np.frombuffer(x, np.int32))[flags[f]].tobytes()
        said = [[{"held": less(x["held"]), "changes": x["changes"]} for x in rows] for rows in b["said"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], pa.array([less(x) for x in b["found"].to_pylist()], pa.binary()), pa.array(said, b["said"].type)], names=["doc_id", "toxic", "found", "said"])

    picked = B.saved(B.map_rows(rows, select, "doc_id long, toxic int, found binary, said array<struct<held:binary,changes:binary>>"))
    got = picked.select("doc_id", "toxic", "found").orderBy("doc_id").collect()
    said = picked.select(F.explode("said").alias("x")).groupBy("x.held", "x.changes").count().orderBy(F.xxhash64("held", "changes"), "held", "changes").limit(max_mentions).collect()
    terms, places, mentions = list(_TERMS), {}, []
    for r in said:
        for change in np.frombuffer(r["changes"], np.int32).reshape(-1, 3).tolist():
            mentions.append((np.frombuffer(r["held"], np.int32), places.setdefault(tuple(change), len(places)), r["count"]))
    swaps = [swap_features(terms[i], terms[j], bool(twice), bits) for i, j, twice in places]
    times = np.zeros(len(swaps))
    for _, i, n in mentions:
        times[i] += n
    weights, bias = fit([np.frombuffer(r["found"], np.int32) for r in got], np.array([float(r["toxic"]) for r in got]), swaps, bits=bits, penalty=penalty, times=times, mentions=mentions)
    del got, said, mentions
    B.relax()
    return Scorer(weights.astype(np.float32), bias, bits)


def score(docs: DataFrame, scorer: Callable[[str], float]) -> DataFrame:
    """All columns of ``docs`` by place (``c0, c1, ...``) and ``score``, from the whole text alone (null: empty)."""
    rows, text = B.numbered(docs), f"c{docs.columns.index('text')}"
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # as many bytes as the model has weights, whatever the corpus

    def each(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        say = shared.value
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([say(x or "") for x in b[text].to_pylist()], pa.float64())], names=[*b.schema.names, "score"])

    return B.map_rows(rows, each, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **how: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row; null and empty texts get the score of no words.

    Null ``doc_id``: scored, never held out. Ties, repeated rows and extra columns change nothing. Empty table: no rows.
    """
    scored = score(docs, train(docs, labels, **how))
    doc = F.col(f"c{docs.columns.index('doc_id')}").cast("long")
    return scored.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **how: float) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with their own columns."""
    scored = score(docs, train(docs, labels, **how))
    return scored.where(F.col("score") < threshold).select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)))

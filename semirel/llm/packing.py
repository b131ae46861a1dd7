"""Best-fit packing of token sequences through a configuration linear program.

Only the histogram of piece lengths reaches the driver (at most ``capacity`` counts,
whatever the corpus). Over it the configuration LP (fewest sequences so that every
length is covered) is solved by multiplicative weights: a length's price falls as it
gets covered, a knapsack dynamic program finds the dearest pattern, and that pattern
is added. The fractional solution is rounded down; what is left over is packed by
patterns again, the longest piece first and the best fill of the rest by a subset-sum
program. Few sequences are stepped through one by one, as smaller steps would round to
nothing. Pieces then find their places by their rank within their length.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semirel.llm import blocks as B

CAPACITY, ROUNDS, MAX_ROUNDS, RATE = 2048, 300, 1200, 4.0
#: Runs without white space from this length on are left to the library whose merge time stays low.
LONG_RUN = 512
PIECES = "doc_id long, piece int, start long, length long, ids binary"


class Tokenizer:
    """Ids as the ``tokenizers`` library gives them for ``json_path`` with ``add_special_tokens=False``.

    ``ranks_path`` may name the same vocabulary as ranks; the faster library then does the
    texts in which neither special strings nor very long runs occur, with equal ids.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.path, self.fast = json_path, None
        with open(json_path, encoding="utf-8") as f:
            special = [re.escape(t["content"]) for t in json.load(f).get("added_tokens", [])]
        self.hard = re.compile("|".join([*special, rf"\S{{{LONG_RUN}}}", rf"\s{{{LONG_RUN}}}"]))
        if ranks_path and pattern:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer as Slow

        return Slow.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not self.hard.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


@functools.lru_cache(maxsize=4)
def tokenizer(*paths: str | None) -> Tokenizer:
    return Tokenizer(*paths)


def default_paths() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def token_pieces(docs: DataFrame, paths: tuple[str | None, ...] | None = None, *, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Each document's ids and then ``end_id``, cut from the end into pieces of ``capacity`` where they are longer.

    Rows ``doc_id, piece, start, length, ids``; ``ids`` holds unsigned 32-bit little-endian
    numbers. Null or empty text: the end id alone. Null or repeated ``doc_id``: pieces like any other.
    """
    paths = paths or default_paths()

    def each(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(*paths).ids
        out: list[list] = [[], [], [], [], []]
        for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
            ids = np.append(encode((text or b"").decode()), np.uint32(end_id)).astype("<u4")
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for x, y in zip(out, (doc, k, i, j - i, ids[i:j].tobytes()), strict=True):
                    x.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return B.map_rows(B.id_and_text(docs), each, PIECES)


# --- the plan, over the histogram alone ----------------------------------------


def knapsack(prices: np.ndarray, capacity: int) -> Counter:
    """The dearest multiset of lengths that fits; ``prices[l]`` is negative infinity where there is no such length."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        sums = best[w - 1 :: -1] + prices[1 : w + 1]
        k = int(sums.argmax())
        if sums[k] > best[w - 1]:
            best[w], last[w] = sums[k], k + 1
        else:
            best[w] = best[w - 1]
    out, w = Counter(), capacity
    while w > 0:
        if last[w]:
            out[int(last[w])] += 1
            w -= int(last[w])
        else:
            w -= 1
    return out


def fill(counts: dict[int, int], capacity: int) -> Counter:
    """The longest length left, and of the others at hand what fills the rest best (longer ones first)."""
    first = max(counts)
    room = capacity - first
    use, reach, via = Counter({first: 1}), 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        n, k = min(counts[length] - (length == first), room // length), 1
        while n > 0:
            take = min(k, n)
            grown = (reach | (reach << (take * length))) & mask
            if grown != reach:
                via.append((length, take, reach))
                reach = grown
            n -= take
            k *= 2
        if reach >> room & 1:
            break
    w = reach.bit_length() - 1
    for length, take, before in reversed(via):
        if not before >> w & 1:
            use[length] += take
            w -= take * length
    return use


def configurations(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """``(pattern, times)``: every length exactly as often as ``counts`` says, in few sequences."""
    left = Counter({k: v for k, v in counts.items() if v and k < capacity})
    plan: list[tuple[dict[int, int], int]] = [({capacity: 1}, counts[capacity])] if counts.get(capacity) else []
    demand = np.zeros(capacity + 1)
    for k, v in left.items():
        demand[k] = v
    bins = float(demand @ np.arange(capacity + 1)) / capacity
    fractional: Counter = Counter()
    covered, some = np.zeros(capacity + 1), demand > 0
    size = np.arange(capacity + 1) / capacity
    for _ in range(MAX_ROUNDS):
        share = np.divide(covered, demand, out=np.ones(capacity + 1), where=some)
        open_ = some & (demand - covered > 1e-9)
        if not open_.any():
            break
        mean = float((share * demand * size)[some].sum() / (demand * size)[some].sum())
        prices = np.where(open_, size * np.exp(-RATE * (share - mean)), -np.inf)
        pattern = knapsack(prices, capacity)
        step = min([max(bins / rounds, 1.0), *((demand[k] - covered[k]) / n for k, n in pattern.items())])
        for k, n in pattern.items():
            covered[k] += step * n
        fractional[tuple(sorted(pattern.items(), reverse=True))] += step
    for pattern, x in fractional.most_common():
        times = min([int(x + 1e-9), *(left[k] // n for k, n in pattern)])
        if times:
            plan.append((dict(pattern), times))
            for k, n in pattern:
                left[k] -= times * n
    left = +left
    while left:
        pattern = fill(left, capacity)
        times = min(left[k] // n for k, n in pattern.items())
        plan.append((dict(pattern), times))
        for k, n in pattern.items():
            left[k] -= times * n
        left = +left
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length rows ``first rank, pieces in a sequence, first sequence, offset`` in order of rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for k, n in sorted(pattern.items(), reverse=True):
            out.setdefault(k, []).append((ranks[k], n, sequence, offset))
            ranks[k] += times * n
            offset += n * k
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``doc_id, piece, length`` with lengths of 1 to ``capacity``.

    Ties and repeated rows are separate pieces. An empty table gives no rows.
    """
    kept = B.saved(pieces)
    at = places(configurations({r[0]: r[1] for r in kept.groupBy("length").count().collect()}, capacity))
    names = kept.columns
    rows = kept.withColumn("_part", F.spark_partition_id())
    before = rows.groupBy("_part", "length").count().select("_part", "length", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part", "length").orderBy("doc_id", "piece"))
    ranked = rows.withColumn("_rank", local - 1).join(before, ["_part", "length"])
    ranked = ranked.select(*names, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["_rank"].to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length).tolist():
                i, table = np.flatnonzero(length == k), at[k]
                first, n, base, offset = table[np.searchsorted(table[:, 0], rank[i], side="right") - 1].T
                seq[i], off[i] = base + (rank[i] - first) // n, offset + (rank[i] - first) % n * k
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return ranked.mapInArrow(run, f"{kind}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` of packed pieces that carry their ``ids``."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("offset").to_numpy())
        ids = b"".join(table.column("ids")[int(i)].as_py() for i in order)
        return pa.table({"sequence_id": table.column("sequence_id").slice(0, 1), "length": pa.array([len(ids) // 4], pa.int64()), "ids": pa.array([ids], pa.binary())})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(run, "sequence_id long, length long, ids binary")

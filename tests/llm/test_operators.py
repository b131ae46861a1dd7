"""Each operator against a brute-force version, over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from semirel.llm import blocks, decontamination, line_dedup, near_copies, packing, pii, sentence_spans, simhash, substring_dedup, suffix_sort, topk_search, toxicity, unigram_lm

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
SPACE = " \t\n\v\f\r"
random.seed(5)
WORDS = ["alpha", "Beta", "gämma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
say = lambda n: " ".join(random.choice(WORDS) for _ in range(n))
SHARED = "One passage stands in many of these texts word for word. It has several sentences of its own. Nobody wrote it twice on purpose."
TEXTS = [
    (3, f"{say(30)}\n{SHARED}\n{say(9)}"),
    (1, f"{SHARED} {say(20)}."),
    (2, f"{SHARED} {say(20)}."),
    (2, f"{SHARED} {say(20)}."),
    (7, None),
    (8, ""),
    (9, " \n\t\n"),
    (10, say(3000)),
    (11, "x" * 5000 + " " + "y" * 700),
    (12, f"short line\nA LONGER LINE HERE\n  a longer line here \n{SHARED}"),
    (13, "A longer line here\n" * 40),
    (14, "short"),
    (None, f"{SHARED} {say(5)}"),
    (None, None),
    (15, "Mail a.b@c-d.example.org or b@x.y.z_c@d.e, 10.0.0.1 and 300.1.1.1 and 1.2.3.4.5; call +1 (017) 555-7713 or +12, card 4539 1488 0343 6467 or 4539148803436468."),
]
TEXTS += [(100 + i, TEXTS[7][1].replace("alpha", "omega", 1 + i)) for i in range(3)] + [(200 + i, TEXTS[1][1]) for i in range(4)]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names clash with those that the operators use."""
    rows = [(d, t, "c0", 5, "x", 0, 1.0) for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, c1 string, block int, TEXT string, split int, score double").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_row(rows):
    return Counter(map(tuple, rows))


def order(doc):
    return math.inf if doc is None else doc


def test_suffix_sort():
    rng = random.Random(1)
    for _ in range(60):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(60, 300))) * rng.randint(1, 3)
        size = rng.choice([8, 16, 30, 50])
        starts = np.arange(len(text) - size + 1)
        lengths = np.minimum(size + np.array([rng.randint(0, 9) for _ in starts]), len(text) - starts)
        got, group = suffix_sort.deep_shallow(text, starts, lengths, rng.choice([0, 8, 24]))
        parts = [text[starts[i] : starts[i] + lengths[i]] for i in got]
        assert parts == sorted(parts)
        assert all((a == b) == (g == h) for a, b, g, h in zip(parts, parts[1:], group, group[1:], strict=False))


@pytest.mark.parametrize("how", ["sorted", "reversed", "equal", "mixed"])
def test_shallow_partitions(how):
    """Any given order of the input, and many equal words, take few rounds and give the order of the bytes."""
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abc") for _ in range(24)) for _ in range(3000)]
    words = {"sorted": sorted(words), "reversed": sorted(words, reverse=True), "equal": [words[0]] * 3000, "mixed": words[:50] * 60}[how]
    text = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    got, begins = suffix_sort.shallow(text, np.arange(3000) * 24, 24)
    assert [words[i] for i in got] == sorted(words) and len(begins) == len(set(words)) and sorted(got.tolist()) == list(range(3000))
    assert all(words[got[b]] != words[got[b - 1]] for b in begins[1:])


@pytest.mark.parametrize("hot", [1, 512])
def test_substring_dedup(docs, none, hot):
    seen, want = [], Counter()
    texts = [(order(d), (t or "").encode()) for d, t in TEXTS]
    holds = defaultdict(set)
    for d, t in texts:
        for i in range(len(t) - 49):
            holds[t[i : i + 50]].add(d)
    for (d, _), (k, t) in zip(TEXTS, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if min(holds[t[i : i + 50]]) < k:
                gone[i : i + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(gone)))
        want[(d, bytes(c for c, g in zip(t, gone, strict=True) if not g), len(t), sum(gone), runs)] += 1
    got = substring_dedup.substring_dedup(docs, hot_docs=hot)
    assert Counter((r[0], bytes(r[1]), *r[2:]) for r in got.collect()) == want and not seen
    assert substring_dedup.substring_dedup(none).collect() == []


@pytest.mark.parametrize("batches,fanout", [(1, 2), (6, 2), (4, 3)])
def test_line_dedup(docs, none, batches, fanout):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    first, want = {}, Counter()
    for d, t in TEXTS:
        for line in (t or "").split("\n"):
            first[key(line)] = min(first.get(key(line), math.inf), order(d))
    for d, t in TEXTS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or order(d) <= first[key(x)]]
        want[(d, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    assert by_row(line_dedup.line_dedup(docs, batches=batches, fanout=fanout).collect()) == want
    whole = line_dedup.line_dedup(docs, batches=batches, fanout=fanout, keep_columns=True)
    assert whole.columns == docs.columns
    assert Counter((r[0], r[1]) for r in whole.collect()) == Counter((k[0], k[1]) for k in want.elements())
    assert line_dedup.line_dedup(none).collect() == []


def test_sentence_spans(docs, none):
    def split(t):
        cuts = [0, *(m.end() for m in re.finditer(rf"[.!?]+[{SPACE}]+|\n[{SPACE}]*", t))]
        cuts += [len(t)] if cuts[-1] < len(t) else []
        return [t[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    words = lambda s: [w for w in re.split(f"[{SPACE}]+", s.translate(LOWER)) if w]
    first, parsed = {}, []
    for d, t in TEXTS:
        parts = split(t or "")
        full = [i for i, s in enumerate(parts) if words(s)]
        said = [tuple(words(parts[i])) for i in full]
        spans = [(p, tuple(said[p:e])) for p in range(len(said)) for e in range(p + 2, len(said) + 1)]  # every run
        spans = [(p, s) for p, s in spans if sum(map(len, s)) >= 12]
        for p, s in spans:
            first[s] = min(first.get(s, (math.inf, math.inf)), (order(d), p))
        parsed.append((d, parts, full, spans))
    want = Counter()
    for d, parts, full, spans in parsed:
        gone = {full[q] for p, s in spans if first[s] < (order(d), p) for q in range(p, p + len(s))}
        want[(d, "".join(s for i, s in enumerate(parts) if i not in gone), len(full), len(gone))] += 1
    got = sentence_spans.span_dedup(docs)
    assert Counter(tuple(r)[:4] for r in got.collect()) == want and any(k[3] for k in want)
    assert sentence_spans.span_dedup(none).collect() == []
    assert want[(13, "A longer line here\n", 40, 39)] == 1


def test_spans_of_short_sentences(spark):
    """A repeated passage goes whole, its short sentences too; what repeats over fewer words stays."""
    short = "".join(f"{w} {w}ly!\n" for w in WORDS)
    tail = "This passage has a sentence of more than twelve words in all to begin with. It ends. So there. "
    texts = [(1, short), (2, f"Own words first.\n{short}Own words last."), (3, tail + "Then one."), (4, tail + "Then another."), (5, "It ends. So there. Once.")]
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_spans"]) for r in sentence_spans.span_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: (short, 0, 0), 2: ("Own words first.\nOwn words last.", 12, 1), 3: (texts[2][1], 0, 0), 4: ("Then another.", 3, 1), 5: (texts[4][1], 0, 0)}


def brute_components(ids, fps, reach):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= reach:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(lambda: math.inf)
    for i, d in enumerate(ids):
        least[find(i)] = min(least[find(i)], order(d))
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("reach", [0, 3, 26])
def test_simhash(docs, none, monkeypatch, reach):
    monkeypatch.setattr(simhash, "LEAF", 3)
    fps = [simhash.simhash((t or "").encode()) for _, t in TEXTS]
    want = brute_components([d for d, _ in TEXTS], fps, reach)
    got = simhash.near_duplicates(docs, max_bits=reach)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    assert by_row((r[0], r[1], order(r[2])) for r in got.collect()) == by_row((d, s, w) for (d, _), s, w in zip(TEXTS, signed, want, strict=True))
    assert simhash.near_duplicates(none).collect() == []


def test_fingerprint_by_hand():
    import xxhash

    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b é", "b é d")]
    assert simhash.simhash("A b\té\nd".encode()) == sum(1 << i for i in range(64) if all(x >> i & 1 for x in h))
    assert simhash.simhash(b"") == 0 and simhash.simhash(b"A  b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_tree_links_are_whole():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64).astype(np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(k)) for k in rng.integers(0, 63, 30)]))
    tree, leaves = simhash.build_tree(fps[::7], 16), defaultdict(lambda: [[], []])
    for k, home, visitors in simhash.route(fps, tree, 3):
        leaves[k][0].append(home)
        leaves[k][1].append(visitors)
    links = set()
    for home, visitors in leaves.values():
        x, root = simhash.linked(np.concatenate(home), np.concatenate(visitors), 3)
        links |= {(int(a), int(x[r])) for a, r in zip(x, root, strict=True)}
    assert sum(len(np.concatenate(h)) for h, _ in leaves.values()) == len(fps)
    group = {int(x): int(x) for x in fps}
    for _ in range(len(fps)):
        before = dict(group)
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    want = brute_components(list(range(len(fps))), [int(x) for x in fps], 3)
    assert len(set(want)) == len(set(group.values()))


@pytest.mark.parametrize("pairs,bucket,close", [(1 << 17, 1 << 17, 3), (3, 8, 0), (3, 1 << 17, 24)])
def test_near_copies(docs, none, monkeypatch, pairs, bucket, close):
    monkeypatch.setattr(near_copies, "LEAD_PAIRS", pairs)
    monkeypatch.setattr(near_copies, "BUCKET_KEYS", bucket)
    monkeypatch.setattr(simhash, "LEAF", 3)
    sets = [set(near_copies.shingle_set((t or "").encode(), 5).tolist()) for _, t in TEXTS]
    same = [" ".join((t or "").lower().split()) for _, t in TEXTS]
    n = len(TEXTS)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if same[i] == same[j] or (None not in (TEXTS[i][0], TEXTS[j][0]) and sets[i] and both >= 0.8 * len(sets[i] | sets[j])):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = len({find(i) for i in range(n)})
    got = near_copies.near_copy_groups(docs, close=close).collect()
    assert len(got) == n and len({r["group_id"] for r in got}) == groups
    kept = near_copies.drop_near_copies(docs, close=close)
    assert kept.columns == docs.columns and kept.count() == groups
    assert near_copies.drop_near_copies(none).collect() == []


def test_near_copies_beyond_reach(spark):
    """Pairs of the similarity whose fingerprints are farther apart than the reach are found as well."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1] + [f"v{i}"] if i % 2 else [f"v{j}" for j in range(6)] + words))]
    once = " ".join(f"u{i}" for i in range(300))
    rows += [(1000, once), (1001, once + " the same five words again" * 300)]
    sets = {d: set(near_copies.shingle_set(t.encode(), 5).tolist()) for d, t in rows}
    want = {(d, d + 1) for d, _ in rows[::2] if len(sets[d] & sets[d + 1]) >= 0.8 * len(sets[d] | sets[d + 1])}
    assert (1000, 1001) in want and len(want) == 301
    groups = defaultdict(set)
    for r in near_copies.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), close=0).collect():
        groups[r["group_id"]].add(r["doc_id"])
    assert {tuple(sorted(g)) for g in groups.values()} == want


def _moved(spark):
    """Bytes that all shuffles so far have written."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_near_copies_move_little(spark, monkeypatch):
    """What a stage moves stays below the text, also where tables are too large to be broadcast and unlike long texts share passages."""
    rng = random.Random(8)
    word = lambda: f"{rng.randrange(10**7):x}"
    passages = [" ".join(word() for _ in range(400)) for _ in range(20)]
    rows = [(i, " ".join([*(word() for _ in range(2200)), passages[i % 20], *(word() for _ in range(2200))])) for i in range(240)]
    rows += [(1000 + i, f"{rows[i][1]} and a few more words") for i in range(0, 240, 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    monkeypatch.setattr(near_copies, "BROADCAST_ROWS", 4, raising=False)
    monkeypatch.setattr(near_copies, "ORDER_TEXTS", 30)  # a small part, as of a large table
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = _moved(spark)
    assert {r[0] for r in near_copies.drop_near_copies(docs).select("doc_id").collect()} == set(range(240))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert _moved(spark) - before < sum(len(t) for _, t in rows)


def test_fine_signatures_are_exact():
    """Two fine signatures differ by no more than their sets, whatever their sizes, also where a place holds more than it can count."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 100, 511, 512, 3000, 40_000):
        for m in (0, n // 2, n, 3 * n):
            x, y = (np.unique(rng.integers(0, 1 << 62, k, dtype=np.uint64)) for k in (n, m))
            for low in (0, 12):  # all shingles in few places
                a, b = np.unique(np.concatenate([x, y[: m // 2]]) >> np.uint64(low)), np.unique(y >> np.uint64(low))
                far = near_copies.apart(*(np.frombuffer(near_copies.fine_signature(z), np.uint8) for z in (a, b)))
                assert far <= len(np.setxor1d(a, b))
    x, y = (np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64) * np.uint64(2)) for _ in range(2))
    assert near_copies.apart(*(np.frombuffer(near_copies.fine_signature(z), np.uint8) for z in (x, y))) > 2 * 12_000 / 9
    assert np.array_equal(near_copies._keys(near_copies._short(x)), x >> np.uint64(24) << np.uint64(24))


@pytest.mark.parametrize("most,bits", [(10**6, 1 << 27), (0, 1 << 27), (0, 64)])
def test_few_rows_meet(spark, monkeypatch, most, bits):
    """Each row with a partner is among those that are to meet it, however small the filter; the rest is whole."""
    monkeypatch.setattr(blocks, "FILTER_BITS", bits)
    rows = spark.createDataFrame([(i if i % 9 else None, i % 4, f"text {i}") for i in range(2000)], "x long, y long, text string")
    known = spark.createDataFrame([(i if i % 9 else None, i % 4) for i in range(0, 2000, 50)] + [(-5, 1)], "d long, t long").distinct()
    some, kept, others = blocks.few(rows, known, {"x": "d", "y": "t"}, most)
    on = lambda r: r["x"].eqNullSafe(kept["d"]) & (r["y"] == kept["t"])
    want = rows.join(known, rows["x"].eqNullSafe(known["d"]) & (rows["y"] == known["t"]), "left_semi").count()
    assert some.join(kept, on(some), "left_semi").count() == want
    rest = [] if others is None else others.collect()
    assert some.count() + len(rest) == 2000 and (others is None) == (most > 0) and (most > 0 or bits < 100 or len(rest) > 1600)
    assert not rest or others.join(kept, on(others), "left_semi").isEmpty()


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_no_task_takes_most_fingerprints(kind):
    """With 64 leaves and more, no task holds over three times the mean of those at work, and none grows with the leaves; every close pair meets."""
    rng = np.random.default_rng(5)
    largest = []
    for n in (1 << 14, 1 << 16):
        fps = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        if kind == "clustered":  # few bits differ from a few centres
            fps = fps[rng.integers(0, 50, n)] ^ (fps & np.roll(fps, 1) & np.roll(fps, 2))
        fps[: n // 100] = fps[-(n // 100) :] ^ np.uint64(0b1001)
        fps = np.unique(fps)
        size = 256
        sample = rng.permutation(fps)[: simhash.SAMPLE_PER_LEAF * (-(-len(fps) // size))]
        tree = simhash.build_tree(sample, -(-len(fps) // size))
        parts = simhash.task_parts(sample, tree, 3, len(fps), size)
        tasks = [(t, len(a) + len(b)) for t, a, b in simhash.cells(fps, tree, 3, *parts) if len(a)]
        assert len({t for t, _ in tasks}) == len(tasks) and len(tree) >= 63
        loads = np.array([k for _, k in tasks])
        assert loads.max() <= 3 * loads.mean()
        largest.append(int(loads.max()))
    assert largest[1] <= 1.5 * largest[0] and largest[1] <= 6 * size


@pytest.mark.parametrize("many", [0, 40])
def test_leading_shingles_are_exact(many):
    """Sets at the similarity share a leading shingle and pass the filters, whatever is known to be frequent."""
    rng = np.random.default_rng(many)
    for n in range(1, 120):
        x = np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.permutation(len(x))[: -(-len(x) * 9 // 10)]], rng.integers(0, 1 << 60, n // 10, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if both < 0.8 * (len(x) + len(y) - both):
            continue
        frequent = np.sort(rng.permutation(x)[:many]), rng.integers(3, 9, min(many, len(x)))
        leads = [near_copies.leading(z, frequent, 0.8) for z in (x, y)]
        key, size, label, at = (np.concatenate(c) for c in zip(*((z, np.full(len(z), s), np.full(len(z), k), np.arange(len(z))) for k, (z, s) in enumerate(zip(leads, (len(x), len(y)), strict=True))), strict=True))
        o = np.lexsort((label, key))
        assert list(near_copies._across(key[o], size[o], label[o], at[o], 0.8))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_paths()[0])
    size, want, length = 64, Counter(), 0
    for d, t in TEXTS:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 0]
        length += len(ids)
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(d, k, i, j - i, np.array(ids[i:j], "<u4").tobytes())] += 1
    packed = packing.pack(packing.token_pieces(docs, capacity=size), capacity=size)
    rows = packed.collect()
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in held.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= size
    assert len(held) <= -(-length // size) + 2
    joined = {r["sequence_id"]: r["length"] for r in packing.sequences(packed).collect()}
    assert joined == {k: sum(n for _, n in v) for k, v in held.items()}
    assert packing.pack(packing.token_pieces(none)).collect() == []


@pytest.mark.parametrize("text", ["<|endoftext|> x", "z" * 2000, " " * 900 + "a", "don't  stop\n\n1234 é漢字 ​", ""])
def test_fast_tokens_equal(text):
    both = packing.Tokenizer(*packing.default_paths())
    assert both.ids(text).tolist() == both.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 30, 3000, 200_000])
def test_configurations(n):
    rng = np.random.default_rng(n)
    counts = Counter(np.clip(np.exp(rng.normal(4, 1, n)).astype(int) + 1, 1, 256).tolist())
    plan, used = packing.configurations(dict(counts), 256), Counter()
    for pattern, m in plan:
        assert sum(k * v for k, v in pattern.items()) <= 256 and m > 0
        for k, v in pattern.items():
            used[k] += m * v
    assert used == counts
    least = -(-sum(k * v for k, v in counts.items()) // 256)
    assert sum(m for _, m in plan) <= least * 1.002 + 2


@pytest.mark.parametrize("n", [30, 300, 700])
def test_few_configurations_use_the_program(monkeypatch, n):
    """Small inputs are packed by the linear program as well, not by the fill of what is left alone."""
    rng, left = np.random.default_rng(n), []
    counts = Counter(np.clip(np.exp(rng.normal(4, 1, n)).astype(int) + 1, 1, 255).tolist())
    fill = packing.fill
    monkeypatch.setattr(packing, "fill", lambda c, capacity: left.append(sum(c.values())) or fill(c, capacity))
    plan, used = packing.configurations(dict(counts), 256), Counter()
    for pattern, m in plan:
        assert sum(k * v for k, v in pattern.items()) <= 256
        for k, v in pattern.items():
            used[k] += m * v
    assert used == counts and left[0] < n
    assert sum(m for _, m in plan) <= -(-sum(k * v for k, v in counts.items()) // 256) * 1.02 + 2


def test_unigram_lm(docs, none):
    got = unigram_lm.score_documents(docs).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split()
    seen = Counter(w for d, t in TEXTS if not held(d) for w in words(t))
    ends = sum(not held(d) for d, _ in TEXTS)
    seen[b"\n"] = ends
    n, kinds = sum(seen.values()), len(seen)
    want = Counter()
    for d, t in TEXTS:
        w = [*words(t), b"\n"]
        base = sum(math.log10((seen[x] + 1) / (n + kinds + 1)) for x in w)
        want[(d, held(d), len(w), sum(seen[x] > 0 for x in w), n, round(base, 6))] += 1
    assert Counter((*r[:5], round(r[5], 6)) for r in map(tuple, got)) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert unigram_lm.score_documents(none).collect() == []


def test_lm_score_is_the_lattices(spark):
    """``score`` against the sum over all segmentations of each word, with scores fitted by a plain version of the fit."""
    rows = [(i, t) for i, t in enumerate(["the thorr reads", "the new été", "", "reads reads the unheardofly long", None, "the the end"])]
    got = {r["doc_id"]: r for r in unigram_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), em_rounds=2).collect()}
    model, prior = unigram_lm.lattice(unigram_lm.default_path()), unigram_lm.PRIOR
    train = [t or "" for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    seen = Counter(w for t in train for w in t.encode().split())

    def ways(text):
        if not text:
            yield []
        for j in range(1, min(len(text), model.longest) + 1):
            if text[:j] in model.id:
                for rest in ways(text[j:]):
                    yield [model.id[text[:j]], *rest]

    listed = {w: list(ways(b" " + w)) for w in {x for _, t in rows for x in (t or "").encode().split()} if len(w) < 12}
    scores, tokens = unigram_lm.first_scores(len(model.pieces)), sum(seen.values())
    for _ in range(2):
        times = np.full(len(model.pieces), prior)
        for w, n in seen.items():
            if w in listed:
                p = [math.exp(sum(scores[k] for k in way)) for way in listed[w]]
                for way, x in zip(listed[w], p, strict=True):
                    for k in way:
                        times[k] += n * x / sum(p)
            else:
                times += n * model.expected([w], np.ones(1), scores)
        scores, stop = unigram_lm.normal_scores(times, model.opens, tokens + prior)
    mass = tokens + len(train) + 2 * prior
    for d, t in rows:
        words = (t or "").encode().split()
        if all(w in listed for w in words):
            want = math.log((len(train) + prior) / mass) + sum(math.log(sum(math.exp(sum(scores[k] for k in way)) for way in listed[w])) + stop + math.log((tokens + prior) / mass) for w in words)
            assert math.isclose(got[d]["score"], want / math.log(10), rel_tol=1e-9), t


def test_lattice_sums_all_segmentations():
    model = unigram_lm.lattice(unigram_lm.default_path())
    scores = unigram_lm.first_scores(len(model.pieces))
    words = [b"the", b"thorreou", "été".encode(), b"x" * 39, b"y" * 41, b"word" * 12]

    def brute(word):
        text, alpha = b" " + word, [1.0] + [0.0] * (len(word) + 1)
        for j in range(1, len(text) + 1):
            alpha[j] = sum(alpha[i] * math.exp(scores[model.id[text[i:j]]]) for i in range(j) if text[i:j] in model.id)
        return math.log(alpha[-1])

    assert np.allclose(model.log_likelihood(words, scores), [brute(w) for w in words])
    counts = np.arange(1.0, len(words) + 1)
    expected = model.expected(words, counts, scores)
    assert math.isclose(sum(e * len(p) for e, p in zip(expected, model.pieces, strict=True)), sum(c * (len(w) + 1) for c, w in zip(counts, words, strict=True)))


def test_toxicity(spark, docs, none):
    rng = random.Random(2)
    rows, marks = [], []
    for d in range(400):
        bad = d % 4 == 0
        rows.append((d, f"{say(20)} {'those foul scoundrels' if bad else 'women and men'} {say(20)}"))
        marks.append((d, 1, int(bad)))
    rng.shuffle(rows)
    texts, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1, 1), (5, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(texts, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert sum(r["predicted"] == (d % 4 == 0) for d, r in got.items()) >= 396
    kept = toxicity.drop_toxic(texts, labels)
    assert kept.columns == texts.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if not r["predicted"]}
    odd = toxicity.toxicity(docs, labels).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.toxicity(none, labels).collect() == []
    assert all(r["score"] < 0.1 for r in toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect())


def test_swap_penalty():
    """An identity term that goes with the label moves the score less under the penalty."""
    f = toxicity.features
    docs = [np.array(f("muslims") + f(f"w{i % 5}")) for i in range(60)] + [np.array(f("christians") + f(f"w{i % 5}")) for i in range(60)]
    labels = np.array([float(i % 10 > 0) for i in range(60)] + [float(i % 10 == 0) for i in range(60)])
    swaps = [(f("muslims"), f("christians"))]
    gap = lambda w: abs(w[f("muslims")].sum() - w[f("christians")].sum())
    free, _ = toxicity.fit(docs, labels, swaps, penalty=0.0)
    held, _ = toxicity.fit(docs, labels, swaps, penalty=5.0)
    assert gap(held) < 0.2 * gap(free)


def labelled_groups(n=400, slur=True):
    """Toxic texts that mention one group, clean ones that mention another, and others without any."""
    rng = random.Random(3)
    word = lambda k: " ".join(f"word{rng.randrange(60)}" for _ in range(k))
    texts, labels = [], []
    for i in range(n):
        group = "muslims" if i < 50 else "christians" if i < 90 else "people"
        texts.append(f"{word(10)}. {word(4)} {group} {word(4)}{' scoundrels' if slur and i % 400 < 50 or i >= 380 else ''}. {word(5)}")
        labels.append(float(i < 50 or i >= 380))
    return texts, np.array(labels)


@pytest.mark.parametrize("slur", [True, False])
def test_penalty_keeps_neutral_groups_neutral(slur):
    """A group that only clean texts mention stays clean under the penalty, and mentions of the other one get cleaner."""
    texts, labels = labelled_groups(slur=slur)
    terms, places, mentions = list(toxicity._TERMS), {}, []
    for x in texts:
        for sentence, changes in toxicity._mentions(x):
            mentions += [(toxicity.text_features(sentence), places.setdefault(c, len(places)), 1) for c in changes]
    swaps = [toxicity.swap_features(terms[a], terms[b], twice) for a, b, twice in places]
    docs = [toxicity.text_features(x) for x in texts]
    say_of = lambda penalty: (lambda s: {g: s(f"word1 word2 {g} word3") for g in ("christians", "muslims", "hindus", "people")})(toxicity.Scorer(*toxicity.fit(docs, labels, swaps, penalty=penalty, mentions=mentions)))
    free, held = say_of(0.0), say_of(1.0)
    assert held["christians"] < 0.02 and held["hindus"] <= max(free["hindus"], held["people"])
    assert held["muslims"] < 0.5 * free["muslims"]
    if slur:  # what is toxic is said by a word, which then carries it
        assert held["christians"] <= free["christians"] + 0.005  # the bias alone moves it
        assert held["muslims"] < 0.1


def test_toxicity_of_repeated_ids(spark):
    """Rows that repeat a labelled id count once for the fit, and each is scored."""
    texts, labels = labelled_groups()
    rows = [(i, t) for i, t in enumerate(texts)]
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, toxic int")
    schema = "doc_id long, text string"
    once = {r["doc_id"]: r["score"] for r in toxicity.toxicity(spark.createDataFrame(rows, schema), marks).collect()}
    twice = toxicity.toxicity(spark.createDataFrame(rows * 3, schema).repartition(4), marks).collect()
    assert len(twice) == 3 * len(rows) and all(abs(once[r["doc_id"]] - r["score"]) < 1e-6 for r in twice)


def test_swaps_of_long_texts(spark, monkeypatch):
    """Terms that come late in a long text are swapped like the first ones, and count as often as they occur."""
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels, swaps, **how: seen.update(swaps=swaps, times=how["times"]) or (np.zeros(1 << toxicity.BITS), 0.0))
    texts = spark.createDataFrame([(0, "These women are here. " * 50 + "Those deaf people too."), (1, "The men and women sing.")], "doc_id long, text string")
    assert not any(zlib.crc32(str(d).encode()) % 3 == 1 for d in (0, 1))
    toxicity.train(texts, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    times = {(tuple(a), tuple(b)): n for (a, b), n in zip(seen["swaps"], seen["times"], strict=True)}
    f = lambda a, b: (tuple(toxicity.features(a)), tuple(toxicity.features(b)))
    assert times[f("women", "men")] == 50 and times[f("women", "girls")] == 51 and times[f("men", "girls")] == 1 and times[f("deaf", "blind")] == 1


def test_decontamination(spark, docs, none):
    question = "the train to Boston leaves at 7 and goes 60 km before the driver Alice stops near the old mill where Alice buys 3 apples"
    bench = spark.createDataFrame([(1, question), (2, "too short"), (3, None), (None, question), (4, SHARED)], "item_id long, text string")
    again = question.replace("Alice", "Robert").replace("7", "9").replace("60", "85").replace("3 apples", "5 apples").replace("Boston", "Denver")
    mixed = question.replace("driver Alice", "driver Robert").replace("where Alice", "where Nobody").replace("7", "9")
    rows = [(1, f"{say(9)} {question} {say(9)}"), (2, f"{say(4)} {again}"), (3, say(60)), (4, None), (5, ""), (6, question.replace("train", "boat").replace("old mill", "new shop").replace("driver", "man")), (7, f"{question} {question}")]
    texts = spark.createDataFrame([*rows, (1, rows[0][1]), (None, question)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(texts, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 1)}
    assert got[1, 1]["verbatim"] and not got[2, 1]["verbatim"] and got[2, 1]["consistent"] == got[2, 1]["slots"]
    mixed_up = decontamination.contaminated(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), bench, min_consistent=1.0)
    assert mixed_up.collect() == []
    kept = decontamination.drop_contaminated(texts, bench)
    assert sorted(order(r["doc_id"]) for r in kept.collect()) == [3, 4, 5, 6, math.inf]
    assert decontamination.contaminated(none, bench).collect() == [] and decontamination.contaminated(texts, none.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert {r["item_id"] for r in decontamination.contaminated(docs, bench).collect()} == {4}


@pytest.mark.parametrize("change", [str.upper, str.lower])
def test_decontamination_in_other_case(spark, change):
    """Names are placeholders only where they are capitalised; a copy in other letters is found by its words."""
    question = "Alice and Bob walk from Boston to Denver while Carol takes the slow train to Chicago and Dave flies 300 km over Ohio with Erin"
    bench = spark.createDataFrame([(1, question)], "item_id long, text string")
    texts = spark.createDataFrame([(1, f"{say(9)} {change(question)} {say(9)}"), (2, say(60)), (3, question)], "doc_id long, text string")
    assert {r["doc_id"] for r in decontamination.contaminated(texts, bench).collect()} == {3}  # the registered query's rule
    assert {r["doc_id"] for r in decontamination.contaminated(texts, bench, folded=True).collect()} == {1, 3}
    assert [r["doc_id"] for r in decontamination.drop_contaminated(texts, bench).collect()] == [2]


def test_decontamination_of_several_occurrences(spark):
    """Copies with other values in one document, or two items of one template, do not hide each other."""
    question = "the train to Boston leaves at 7 and goes 60 km before the driver Alice stops near the old mill where Alice buys 3 apples"
    swap = lambda a, b, c: question.replace("Alice", a).replace("7", b).replace("60", c).replace("3 apples", f"{b}1 apples").replace("Boston", f"{a}ton")
    other, third = swap("Robert", "9", "85"), swap("Nora", "8", "77")
    longer = other.replace("Robertton", "New Denver")
    bench = spark.createDataFrame([(1, question), (2, other)], "item_id long, text string")
    hidden = swap("Robert", "9", "85").replace("driver Robert", "driver Zoe").replace("goes 85", "goes 9")
    rows = [(1, f"{question} {say(9)} {other}"), (2, f"{other} {third} {say(5)}"), (3, f"{longer} {third}"), (4, say(60))]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(texts, bench).collect()}
    assert (1, 1) not in whole and (1, 2) not in whole  # the registered query's rule
    apart = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(texts, bench, apart=True).collect()}
    assert set(apart) == {(d, i) for d in (1, 2, 3) for i in (1, 2)} and apart[1, 1]["verbatim"] and apart[1, 2]["verbatim"]
    assert [r["doc_id"] for r in decontamination.drop_contaminated(texts, bench).collect()] == [4]
    mixed = spark.createDataFrame([(1, hidden)], "doc_id long, text string")
    assert decontamination.contaminated(mixed, bench.where("item_id = 1"), apart=True, min_consistent=1.0).collect() == []


def test_decontamination_sql(spark, tmp_path):
    """The SQL reads re-parameterised questions as the operator does."""
    import duckdb

    from semirel.llm import queries

    question = "the train to Boston leaves at 7 and goes 60 km or 5kg before the driver Alice stops near the old mill where Alice buys 3 apples"
    rows = [(1, question), (2, question.replace("Alice", "Robert").replace("60 km", "85 mi").replace("5kg", "9lb")), (3, question.replace("driver Alice", "driver Bob")), (4, None), (5, "Ab-Cd " * 9), (6, SHARED), (7, say(30)), (7, question.upper()), (8, f"{question} {say(5)} {question.replace('Alice', 'Nora').replace('7', '8')}")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, question), (2, SHARED), (3, None)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op8_template_decontamination"])
    got = queries.QUERIES["op8_template_decontamination"](spark, str(tmp_path))
    found = sorted(tuple(r[c] for c in want.columns) for r in got.collect())
    assert found == sorted(want.fetchall()) and {r[:2] for r in found} >= {(1, 1), (2, 1), (6, 2), (7, 1), (8, 1)}


def test_decontamination_of_repeated_ids_and_long_texts(spark):
    """Each row of an id is read by itself; repeats and numbers of very long texts take time in proportion."""
    import time

    question = "the train to Boston leaves at 7 and goes 60 km before the driver Alice stops near the old mill where Alice buys 3 apples"
    bench = spark.createDataFrame([(1, question), (2, SHARED)], "item_id long, text string")
    rows = [(1, f"{say(9)} {question} {say(9)}"), (1, f"{say(30)} {question}"), (1, say(50)), (2, f"{question} " * 8000), (3, "a12 b 7 km " * 100_000)]
    began = time.time()
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), bench, folded=True, apart=True).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 1)} and all(r["verbatim"] for r in got)
    assert time.time() - began < 90


def test_personal_data_of_long_texts(spark):
    """Numbers of a long text take time in proportion to it."""
    import time

    text, began = "1.2.3.4 a12 b " * 40_000, time.time()
    (row,) = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(row["spans"]) == 40_000 and all(text[s["start"] : s["end"]] == "1.2.3.4" for s in row["spans"]) and row["spans"][-1]["end"] == len(text) - 7
    assert time.time() - began < 60


@pytest.mark.parametrize("name", ["op1_topk_search", "op7_line_dedup", "op8_template_decontamination", "op9_sentence_spans", "op10_information_sanitisation"])
def test_sql(spark, sf, name):
    import duckdb

    from semirel.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(tuple(r[c] for c in want.columns) for r in queries.QUERIES[name](spark, sf).collect()) == sorted(want.fetchall())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in double) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


ODD = ["a@b.c@d.e_f@g.h", "é a.b@c.d.", "x@y 1.2.3.4.5.6.7.8 0256.1.1.1 001.2.3.4", "+1+2 (3) 4567890 +123456789012345678", "4111 1111 1111 1111-4111111111111111", "9" * 4000, "a" * 3000 + "@b.cc", "+" * 500, "1." * 900, " a@b.cc "]


def test_personal_data(spark, docs, none):
    texts = [t or "" for _, t in TEXTS] + ODD
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_personal_data(df).collect()}
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m.group())]
        assert [s for s in got[i] if s[0] != "term"] == want, t[:80]
    assert pii.find_personal_data(docs).count() == len(TEXTS)
    assert pii.find_personal_data(none).collect() == []


def check_sql(spark, folder, rows):
    import duckdb

    from semirel.llm import queries

    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op10_information_sanitisation"])
    got = queries.QUERIES["op10_information_sanitisation"](spark, str(folder)).collect()
    assert sorted((tuple(r[c] for c in want.columns) for r in got), key=repr) == sorted(want.fetchall(), key=repr)
    assert any("term" in r["spans"] for r in got)


def test_disclosing_terms(spark, tmp_path):
    rows = [(i, f"{say(8)} project nightingale write to jane@corp.example {say(8)}") for i in range(8)] + [(i, f"{say(20)} nightingale") for i in range(8, 12)] + [(i, say(25)) for i in range(12, 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal_data(df)
    check_sql(spark, tmp_path, [*rows, *((1000 + i, t) for i, t in enumerate(ODD)), *TEXTS])
    terms = {(r["doc_id"], r["text"][s["start"] : s["end"]]) for r in found.collect() for s in r["spans"] if s["kind"] == 4}
    assert {(i, "nightingale") for i in range(12)} <= terms and {w for _, w in terms} <= {"nightingale", "project", "write"}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(found).collect()}
    assert "jane@" not in clean[0] and "<email>" in clean[0] and "nightingale" not in clean[9] and clean[500] == dict(rows)[500]
    assert "<" not in {r["doc_id"]: r["text"] for r in pii.sanitise(found, remove=True).collect()}[0]


def test_terms_of_an_entity_in_many_documents(spark, tmp_path):
    """A third of all documents hold the entity: a term that never stands without it gives it away, one that often does not."""
    rows = [(i, f"{say(8)} nightingale kestrel desk@corp.example {say(8)}") for i in range(40)] + [(i, f"{say(20)} kestrel {say(4)}") for i in range(40, 60)] + [(i, say(25)) for i in range(60, 120)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["text"][s["start"] : s["end"]] for r in found.collect() for s in r["spans"] if s["kind"] == 4} == {"nightingale"}
    check_sql(spark, tmp_path, rows)


@pytest.mark.parametrize("remove", [False, True])
def test_sanitise(spark, remove):
    """Against plain slicing, with overlaps, ends that touch, spans at both ends, repeated and null rows; long texts take time in proportion."""
    import time

    rng = random.Random(8)
    rows = [(None, "no spans", []), (1, None, []), (2, "", []), (3, "abc", [(4, 0, 3, "abc")])]
    for d in range(40):
        text = "".join(rng.choice("aé漢😀 \n") for _ in range(rng.choice([5, 127, 128, 129, 700])))
        spans = sorted({(a := rng.randrange(len(text)), min(len(text), a + rng.randint(1, 160)), rng.randrange(5)) for _ in range(rng.randint(0, 9))})
        rows += [(d, text, [(k, a, b, text[a:b]) for a, b, k in spans])] * (1 + d % 2)
    long = "1.2.3.4 a12 b " * 40_000
    rows.append((99, long, [(1, 14 * i, 14 * i + 7, "1.2.3.4") for i in range(40_000)]))

    def clean(text, spans):
        out, at = "", 0
        for a, b, k in sorted((a, b, k) for k, a, b, _ in spans):
            if a >= at:
                out += text[at:a] + ("" if remove else f"<{pii.KINDS[k]}>")
            at = max(at, b)
        return out + text[at:]

    want = Counter((d, t if t is None else clean(t, s)) for d, t, s in rows[:-1])
    want[99, " a12 b " * 40_000 if remove else "<ip> a12 b " * 40_000] += 1
    began = time.time()
    assert by_row(pii.sanitise(spark.createDataFrame(rows, f"doc_id long, text string, spans array<{pii.SPAN}>"), remove=remove).collect()) == want
    assert time.time() - began < 60


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.12, 16).tolist(), 1) for i in range(300)]
    rows += [(300 + i, rows[40][1], 1) for i in range(30)]  # ties
    rows += [(400, None, 1), (420, [1.0, None], 1), (440, [float("nan")] * 16, 1), (460, [float("inf")] * 16, 1), (480, [], 1), (500, [0.5], 1), (None, rows[0][1], 1), (40, rows[40][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    ints = [(i, [math.floor(64 * np.float64(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for q, a in ints:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in ints if c != q)[:20]
            want.update((q, r + 1, c, -s) for r, (s, c) in enumerate(scored))
    assert by_row(topk_search.top_k(df, F.col("vec_id") % 20 == 0).collect()) == want
    small = df.where("vec_id in (20, 21)")
    assert small.count() == 2 and [tuple(r)[:3] for r in topk_search.top_k(small, F.col("vec_id") == 20).collect()] == [(20, 1, 21)]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_top_k_of_large_components(spark):
    """Nothing is clipped: components of 1e7 and more count as floor(64 * x), and sums near 64 bits are exact."""
    rng = np.random.default_rng(4)
    for scale in (1e7, 1.5e7):
        vectors = (rng.normal(0, scale, (60, 8))).tolist()
        ints = [[math.floor(64 * x) for x in v] for v in vectors]
        df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
        got = defaultdict(list)
        for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        for q in (0, 20, 40):
            scored = sorted((-sum(x * y for x, y in zip(ints[q], v, strict=True)), i) for i, v in enumerate(ints) if i != q)[:20]
            assert got[q] == [(i, -s) for s, i in scored]


def test_early_stop_is_exact():
    rng = np.random.default_rng(1)
    vectors = np.floor(64 * rng.normal(0, 0.125, (3000, 32)) * np.exp(rng.normal(0, 1, 32))).astype(np.int64)
    ids = rng.permutation(3000)
    index = topk_search.ImpactIndex(ids, vectors)
    found = index.search(vectors[:40], 20, ids[:40])
    assert index.processed < index.total
    for q in range(40):
        score = vectors @ vectors[q]
        best = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if i != ids[q])[:20]
        assert [(-int(s), int(index.ids[p])) for p, s in zip(*found[q], strict=True)] == best


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 3), (200, 200)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_digest_matches_text(docs):
    kept = line_dedup.line_dedup(docs).select("text", F.sha2(F.col("text").cast("binary"), 256).alias("h")).collect()
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["h"] for r in kept)

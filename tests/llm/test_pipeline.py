"""The whole pipeline against a stage-by-stage brute-force version: whole texts, plain loops, all pairs."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from semirel.llm import packing, toxicity

pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
SPACE = " \t\n\v\f\r"
ITEM = "A trader named Robert sells 12 boxes of green tea for 30 dollars and then buys back 7 boxes at half of that price before the market closes"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, c0 string, block int, score double, row int, label int"


def written_words():
    rng = random.Random(11)
    words = ["".join(rng.choice("abdeilmnorstu") for _ in range(6)) for _ in range(400)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


def rows_of():
    say = written_words()
    rows = [(d, f"{say(20)} {'those foul scoundrels' if d % 4 == 0 else 'women and men'} {say(20)}") for d in range(400)]
    near, line, short = say(120).split(), say(9), "\n".join(say(1)[:6] for _ in range(9))
    rows += [(500, f"{say(15)}\n  {line.upper()}\n{say(8)}"), (501, f"{say(15)}\n{line}\n{say(8)}"), (502, line)]
    rows += [(512 - i, " ".join([*near[:40], f"other{'abc'[i]}", *near[41:]])) for i in range(3)]
    rows += [(521, short), (520, short), (521, short), (521, short)]
    rows += [(530, f"{say(30)}. {ITEM}. {say(30)}"), (531, f"{say(30)}. {ITEM.replace('12', '48').replace('30', '90')}. {say(30)}"), (532, f"{say(30)}. {ITEM.lower()}. {say(9)}")]
    rows += [(540, None), (541, ""), (542, " \n\t"), (543, say(3000)), (544, "x" * 20_000), (None, say(25)), (None, None)]
    return rows


def stayed_lines(rows):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    order = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first.get(key(x), float("inf")), order(d))
    return [(d, "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or order(d) <= first[key(x)])) for d, t in rows]


def one_of_each_group(rows):
    def shingles(t):
        w = t.translate(LOWER).split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            known = None not in (rows[i][0], rows[j][0]) and sets[i]
            if rows[i][1].translate(LOWER).split() == rows[j][1].translate(LOWER).split() or (known and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    held = defaultdict(list)
    for g, (d, t) in zip(group, rows, strict=True):
        held[g].append((d is None, d if d is not None else 0, np.int64(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42))), t))
    return [(None if null else d, t) for null, d, _, t in (min(v) for v in held.values())]


def write(spark, folder, rows, benchmark, labels):
    full = [(d, t, "en", "web", len(t or ""), "x", 5, 0.5, 1, 2) for d, t in rows]
    spark.createDataFrame(full, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = rows_of()
    write(spark, tmp_path, rows, [(1, ITEM), (2, None), (None, ITEM), (3, "")], [*((d, 1, int(d % 4 == 0)) for d in range(400)), (None, 1, 1), (7, None, None)])
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    # the classifier is learned: its decisions are taken as given, and held to what was planted
    rejected = {r["doc_id"] for r in toxicity.toxicity(docs, labels).collect() if r["predicted"]}
    assert len(rejected ^ {d for d in range(400) if d % 4 == 0}) <= 8
    kept = one_of_each_group(stayed_lines([x for x in rows if x[0] not in rejected]))
    assert {510, 520, 500, 543} <= {d for d, _ in kept} and not {511, 512, 521} & {d for d, _ in kept}
    kept = [(d, t) for d, t in kept if d not in (530, 531, 532)]
    slow = Tokenizer.from_file(packing.default_paths()[0])
    want, total = Counter(), 0
    for d, t in kept:
        ids = [*slow.encode(t, add_special_tokens=False).ids, 0]
        total += len(ids)
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(d, k, i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes()))] += 1
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in held.values():
        assert [a for a, _ in sorted(v)] == np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() and sum(n for _, n in v) <= 2048
    assert len(held) <= -(-total // 2048) + 2


def test_each_stage_keeps_the_columns(spark, tmp_path):
    write(spark, tmp_path, [(1, "one clean text of several words"), (2, None), (None, "")], [(1, ITEM)], [(1, 1, 0)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        assert {r["doc_id"] for r in out.collect()} >= {1}, name


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path / "all", [], [], [])
    assert pipeline.run(spark, f"{tmp_path}/all").collect() == []
    write(spark, tmp_path / "docs_only", [(1, "one clean text of several words"), (2, None)], [], [])
    got = pipeline.run(spark, f"{tmp_path}/docs_only")
    assert {r["doc_id"] for r in got.select(F.col("doc_id")).collect()} == {1, 2}


def test_training_sequences(spark, tmp_path):
    """The ids themselves, in the order of the pieces, and no folders of stages that nothing reads any more."""
    from semirel.llm import blocks

    blocks.ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    listed = lambda path: [str(x.getPath()) for x in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    before, say = set(listed(folder)), written_words()
    texts = {d: say(30 + d) for d in range(6)}
    write(spark, tmp_path, list(texts.items()), [(1, ITEM)], [])
    (row,) = pipeline.training_sequences(spark, str(tmp_path)).collect()
    slow = packing.Tokenizer(*packing.default_paths()).slow
    ends = np.frombuffer(bytes(row["ids"]), "<u4")
    pieces = Counter(tuple(x.tolist()) for x in np.split(ends, np.flatnonzero(ends == 0) + 1)[:-1])
    assert row["length"] == len(ends) and pieces == Counter((*slow.encode(t, add_special_tokens=False).ids, 0) for t in texts.values())
    left = [x for x in set(listed(folder)) - before if "/pipeline-" in x]
    assert len(left) == 1 and [x.rsplit("/", 1)[1] for x in listed(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(left[0]))] == ["benchmark_decontamination"]

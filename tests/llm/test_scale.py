"""What keeps one key, however frequent, from becoming one task's or the driver's burden."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.llm import common, graph, lattice, mixing, packing, simhash
from tallyframe.llm.q_packing import tokenizer

ROOT = Path(__file__).resolve().parents[2]


def brute_roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root if find(x) != x}


def test_components_with_hubs(spark):
    rng = np.random.default_rng(1)
    star = [(5000, i) for i in range(4000)] + [(i, 9000) for i in range(4001, 4500)]
    chain = [(20_000 + i, 20_001 + i) for i in range(70)]
    some = [tuple(map(int, rng.choice(3000, 2, replace=False) + 30_000)) for _ in range(1500)]
    edges = star + chain + some + [(9000, 4400)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.a: r.b for r in got.collect()} == brute_roots(edges)
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_no_task_gathers_a_hub(spark):
    """A node's edges stay where they are; the join gets those of nodes with few."""
    rows = spark.createDataFrame([(1, i) for i in range(2, 5000)] + [(i, 1) for i in range(2, 5000)], "a long, b long")
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    got = graph._with_least(rows, least, rows.count())
    assert got.count() == rows.count() and got.where("a = 1 AND m <> 2").count() == 0
    assert least.where(F.col("n") > max(graph.HUB, rows.count() // graph.HUBS)).count() == 1


def test_bins_of_low_quality_documents_are_small(spark):
    u = (F.rand(7) + 1e-12).alias("u")
    for quality in (0.05, 0.2, 1.0):
        keys = spark.range(200_000).select(F.floor(mixing.STEPS * F.log2(-F.log(u) / quality)).alias("bin"))
        assert keys.groupBy("bin").count().agg(F.max("count")).first()[0] < 200_000 / 2000


def test_sources_of_symbols_meet_their_target(spark):
    docs = spark.createDataFrame([(i, "#$% " * 40 + "w " * (i % 7), "s") for i in range(400)] + [(1000 + i, "word " * 30, "t") for i in range(100)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    for s in "st":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2


def test_frequent_words_are_bounded_in_number_and_bytes(spark):
    rows = [(f"w{i}".encode(), 1 + 1000 // (i + 1)) for i in range(3000)]
    counts = spark.createDataFrame([(bytearray(w), c) for w, c in rows], "word binary, c long")
    want = dict(rows)
    for head, size in ((0, 1 << 20), (10, 1 << 20), (100, 1 << 20), (5000, 1 << 20), (5000, 60)):
        got = lattice.frequent(counts, head, size)
        assert len(got) <= head and sum(map(len, got)) <= size and all(want[w] == c for w, c in got.items())
        assert min(got.values(), default=10**9) >= max((c for w, c in rows if w not in got), default=0)
    assert len(lattice.frequent(counts, 5000)) == 3000 and lattice.frequent(counts.limit(0), 9) == {}


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    from tallyframe.llm.q_lattice import pieces

    docs = spark.createDataFrame([(i, f"the w{i % 37} and thening w{i % 11} {'x' * (i * 9 % 260)}") for i in range(60)], "doc_id long, text string")
    a, b = (sorted(map(tuple, lattice.score(docs.repartition(n), pieces(), head=20).collect())) for n in (2, 7))
    assert a == b


def test_first_weights_follow_the_ranks_of_merges():
    """Zipf's law over the ranks: the weights of two pieces are as (rank + 10) inverted."""
    import sentencepiece

    from tallyframe.llm.q_lattice import pieces

    found, prob = lattice.vocabulary(pieces())
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces())
    rank = np.minimum([-sp.get_score(sp.piece_to_id(p)) for p in found], 1e6)  # the space mark alone is no merge
    assert np.allclose(prob[: len(found)] * (rank + 10) / (prob[0] * (rank[0] + 10)), 1) and abs(prob.sum() - 1) < 1e-12


def test_full_pieces_and_rows_without_ids_are_spread(spark):
    docs = spark.createDataFrame([(None, "same text of a few words")] * 3000 + [(i, "a " * 2047) for i in range(5)] + [(9, "b " * 5000)], "doc_id long, text string")
    got = packing.pack(docs, tokenizer()).collect()
    full = [r for r in got if r.length == 2048]
    assert len(full) == 5 + 2 and len({r.sequence_id for r in full}) == 7 and all(r.sequence_id < 0 and r.offset == 0 for r in full)
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(got) == 3000 + 5 + 3
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length


def test_an_anchor_over_many_batches_is_compared_whole():
    rng = np.random.default_rng(4)
    base = np.uint64(rng.integers(0, 1 << 60))
    near = np.unique(np.array([base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(46, 64, (200, 2))], np.uint64))
    index, key = simhash.replicas(near)
    order = np.argsort(key, kind="stable")
    key, fp = key[order].astype(np.int32), near[index][order].view(np.int64)
    cut = lambda n: [pa.RecordBatch.from_arrays([pa.array(key[i : i + n]), pa.array(fp[i : i + n])], names=["key", "fp"]) for i in range(0, len(key), n)]
    pairs = [brute_roots([(int(a), int(b)) for batch in simhash._compared(iter(cut(n))) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]) for n in (7, 100, len(key))]
    assert pairs[0] == pairs[1] == pairs[2] and len(pairs[0]) == len(near) - 1


def test_batches_are_cut_and_settings_stay(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    got = [r.n for r in spark.range(0, 9000, 1, 2).mapInArrow(common.bounded(sizes, 1000), "n long").collect()]
    assert sum(got) == 9000 and max(got) <= 1000
    long = [r.n for r in spark.range(0, 50, 1, 1).select(F.repeat(F.lit("x"), 100_000)).mapInArrow(common.bounded(sizes, 1000, 1 << 20), "n long").collect()]
    assert sum(long) == 50 and max(long) <= 11
    simhash.near_duplicates(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
    assert before == {k: spark.conf.get(k) for k in before}


CLUSTER = """
from pyspark.sql import SparkSession
from tallyframe.shared import shared_folder
from tallyframe.llm import common
import os, sys
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
path = common.own_folder(spark)
kept = common.cut(spark.range(3))
assert kept.count() == 3
print("PATH", path.removeprefix("file:"))
type(spark.sparkContext).master = property(lambda self: "spark://somewhere:7077")
spark.sparkContext._checkpointed = None
class NoFolder:
    master = "spark://somewhere:7077"
    def getCheckpointDir(self): return None
class Session:
    sparkContext = NoFolder()
    class conf:
        get = staticmethod(lambda k, d=None: d)
try:
    shared_folder(Session())
except ValueError as e:
    print("REFUSED")
"""


def test_tables_go_at_the_end_and_clusters_must_name_a_folder():
    done = subprocess.run([sys.executable, "-c", CLUSTER], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=200)
    assert "REFUSED" in done.stdout, done.stderr[-2000:]
    path = next(x.split(" ", 1)[1] for x in done.stdout.splitlines() if x.startswith("PATH"))
    assert not os.path.exists(path)

import re
from collections import Counter

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_mixing import brute_targets
from test_pii import brute as spans_of
from test_quality import brute as counts_of
from test_simhash import brute_components, brute_fingerprint

from tallyframe.llm import quality

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "src1", 0), (10_003, "x " * 100, None, "src1", 200)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(3))
    judged = quality.assess(docs).where("kept")
    frames = [docs.toPandas()]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        frames.append(docs.toPandas())
        if i < len(pipeline.STAGES) - 1:
            assert sorted(docs.columns) == sorted(pipeline.COLUMNS)
    raw, good, single, clean, mixed, packed = frames

    assert all(not counts_of(t)["base_failed"] for t in good.text)
    assert sorted(good.doc_id) == sorted(r.doc_id for r in judged.collect()) and len(good) == sum(d in set(good.doc_id) for d in raw.doc_id)

    fps = [brute_fingerprint(t) for t in good.text]
    ids = good.doc_id.tolist()
    assert sorted(single.doc_id) == sorted(set(brute_components(fps, ids)))
    by_id = dict(zip(good.doc_id, good.text, strict=True))
    assert all(by_id[d] == t for d, t in zip(single.doc_id, single.text, strict=True))

    before = dict(zip(single.doc_id, single.text, strict=True))
    for d, t, n in zip(clean.doc_id, clean.text, clean.n_chars, strict=True):
        assert n == len(t) and not spans_of(t)
        if t != before[d]:
            assert re.search(r"<(email|ip|card|phone|secret)>", t)
        else:
            assert not spans_of(t)
    assert sorted(clean.doc_id) == sorted(single.doc_id)

    size = Counter()
    for s, t in zip(clean.source, clean.text, strict=True):
        size[s] += len(t.encode().split())
    taken = Counter()
    for s, t in zip(mixed.source, mixed.text, strict=True):
        taken[s] += len(t.encode().split())
    most = Counter()
    for s, t in zip(clean.source, clean.text, strict=True):
        most[s] = max(most[s], len(t.encode().split()))
    assert all(abs(taken[s] - x) <= most[s] / 2 + 1e-6 for s, x in brute_targets(size).items())

    whole = packed[packed.piece == 0].groupby("doc_id").size()
    assert whole.to_dict() == mixed.groupby("doc_id").size().to_dict()
    at = packed.sort_values(["sequence_id", "offset"])
    assert (at.offset == at.groupby("sequence_id").length.cumsum() - at.length).all() and at.groupby("sequence_id").length.sum().max() <= 2048


def test_run_equals_the_stages(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "simhash near-dedup", "personal data", "source mixing", "best-fit packing"]
    assert set(pipeline.run(spark, SF).columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_stages_and_run_over_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    wide = docs.withColumn("row", F.lit(1)).withColumn("c", F.lit("x")).withColumn("m", F.lit(2.0))
    for _, stage in pipeline.STAGES:
        assert stage(spark, wide, str(tmp_path)).collect() == []
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_columns_with_clashing_names_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = "row c m fp digest component_id found size target key bin part copies label kept m_lang lang2".split()
    wide = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in pipeline.STAGES[:4]:
        a, b = stage(spark, docs, SF), stage(spark, wide, SF)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name

import hashlib

import corpus_pipeline
import public_tokenizers as public
import tiktoken
from pyspark.sql import functions as F
from voxelstream.llm import bpe, decontamination, exact_dedup, quality
from voxelstream.llm.common import materialize

from test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    """Each stage against its report, or brute force, on the same input; the run against the stages one after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    reports = [
        lambda d: quality.quality(d, labels).where("predicted = 1"),
        lambda d: exact_dedup.exact_dedup(d).where("kept"),
        None,
        lambda d: decontamination.decontaminate(d, benchmark).where("not contaminated"),
    ]
    sizes = [docs.count()]
    for (_, stage), report in zip(corpus_pipeline.STAGES[:-1], reports, strict=True):
        kept = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert kept.columns == docs.columns
        want = sorted(r["doc_id"] for r in report(docs).collect()) if report else sorted(brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()]))
        assert sorted(r["doc_id"] for r in kept.collect()) == want
        docs = kept
        sizes.append(docs.count())
    assert 0 < sizes[-1] < sizes[0]
    ranks = bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r["doc_id"]: hashlib.sha256(",".join(map(str, reference.encode_ordinary(r["text"]))).encode()).hexdigest() for r in docs.collect()}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_odd_tables(spark, docs, rows, empty, tmp_path):
    """Nulls, repeated rows, clashing names and empty tables go through all stages."""
    sf = str(tmp_path)
    labels = spark.createDataFrame([(i, int(len(t or "") > 60)) for i, t in rows], "doc_id long, quality int").withColumn("toxic", F.lit(None).cast("int"))
    items = spark.createDataFrame([(1, rows[1][1][:90]), (None, "x"), (2, None)], "item_id long, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", items)):
        table.write.parquet(f"{sf}/{name}.parquet")
    stages, before = corpus_pipeline.STAGES, docs
    for name, stage in stages[:-1]:
        kept = materialize(stage(spark, before, sf), name)
        assert kept.dtypes == before.dtypes and kept.exceptAll(before).isEmpty()
        assert kept.count() < before.count() or name == "benchmark_decontamination"
        before = kept
    out = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, out.collect())) == sorted(map(str, stages[-1][1](spark, before, sf).collect()))
    none = str(tmp_path / "none")
    for name, table in (("documents", empty), ("labels", labels.where("false")), ("benchmark", items.where("false"))):
        table.write.parquet(f"{none}/{name}.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0

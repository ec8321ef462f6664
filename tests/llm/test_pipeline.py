"""Stages against plain versions of what each decides."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from glasswatch.llm import decontaminate, secretscan
from glasswatch.llm.common import written

from .helpers import LARGER, edge_docs, rows
from .test_decontaminate import distance_to_part
from .test_secretscan import brute as secrets
from .test_simhash import fingerprint, groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE encoding and decoding"]
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, LARGER))
        assert name.startswith("byte") or docs.columns == COLUMNS
        out.append(docs.toPandas().set_index("doc_id"))
    good, single, clean, masked, coded = out
    labels = {x["doc_id"]: x["quality"] for x in rows("labels", LARGER)}
    assert not [i for i in good.index if labels.get(i) == 0]
    ids = sorted(good.index)
    want = groups(ids, [fingerprint(good.text[i]) for i in ids])
    assert sorted(single.index) == sorted(set(want.values()))
    items = decontaminate.normal_texts([x["text"] for x in rows("benchmark", LARGER)])
    texts = dict(zip(single.index, decontaminate.normal_texts(list(single.text))))
    gone = set(single.index) - set(clean.index)
    assert {i for i, t in texts.items() if any(x in t for x in items)} <= gone
    assert all(any(distance_to_part(x, texts[i])[0] <= int(decontaminate.RATE * len(x)) for x in items) for i in gone)
    assert sorted(masked.index) == sorted(clean.index) == sorted(coded.index)
    for i in masked.index:
        assert not secrets(masked.text[i]) and masked.n_chars[i] == len(masked.text[i])
        if not secrets(clean.text[i]) and "[SECRET]" not in masked.text[i]:
            assert masked.text[i] == clean.text[i]
        assert coded.decoded_sha256[i] == hashlib.sha256(masked.text[i].encode()).hexdigest()
    assert corpus_pipeline.run(spark, LARGER).count() == len(coded)


def test_edges(spark):
    for empty in (False, True):
        docs = edge_docs(spark, empty)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, LARGER)
            assert name.startswith("byte") or got.columns == docs.columns
            assert got.count() >= 0
    kept = corpus_pipeline.near_dedup(spark, edge_docs(spark), LARGER)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "None"]


def test_secret_model_is_bounded(spark):
    docs = edge_docs(spark).withColumn("text", F.repeat(F.coalesce("text", F.lit("")), 1))
    assert len(secretscan.fit(secretscan.samples(spark, docs))) == secretscan.SIZE ** 2


def test_repeated_and_missing_ids(spark):
    one, two = "a clean text of its own about the sea and the wind", "another text that has nothing in common with the first one"
    df = spark.createDataFrame([(1, one), (1, two), (None, "lone words here for a copy without an id"),
                                (None, "lone words here for a copy without an id"), (2, one)], "doc_id int, text string")
    got = sorted(((r.doc_id or 0), r.text) for r in corpus_pipeline.near_dedup(spark, df, LARGER).collect())
    assert got == sorted([(1, one), (1, two), (0, "lone words here for a copy without an id")])

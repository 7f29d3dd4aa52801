"""The pipeline against a plain version, stage by stage."""

import re
import zlib

import numpy as np

import corpus_pipeline
from cellwright.llm import packing, quality_knn
from cellwright.llm.queries import tokenizer_path
from cellwright.llm.storage import Scratch

from .test_operators import base_spans, components_of, grams

SRC = "/root/testdata/sf0.001"


def test_stages_are_brute_force(spark):
    docs = spark.read.parquet(f"{SRC}/documents.parquet")
    scratch = Scratch(spark, "t")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(scratch.put(stage(spark, kept[-1], SRC), name))
        if name != "packed":
            assert kept[-1].columns == docs.columns
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    got = [{r.doc_id: r.text or "" for r in k.collect()} for k in kept[1:-1]]

    scores = {r.doc_id: r.score for r in quality_knn.classify(docs, spark.read.parquet(f"{SRC}/labels.parquet")).collect()}
    assert got[0] == {i: t for i, t in rows.items() if scores[i] >= 0.3}
    bad = {r.doc_id for r in spark.read.parquet(f"{SRC}/labels.parquet").where("quality = 0").collect()}
    assert len(bad & set(got[0])) <= 0.1 * len(bad)

    best = {}
    for i, t in sorted(got[0].items()):
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        if k not in best or len(t) > len(got[0][best[k]]):
            best[k] = i
    assert set(got[1]) == set(best.values())

    sets = {i: grams(t) for i, t in got[1].items()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = components_of(ids, links)
    assert set(got[2]) == {i for i in ids if group[i] == i}

    assert set(got[3]) == set(got[2])
    for i, t in got[3].items():
        assert (t == got[2][i]) == (base_spans(got[2][i]) == "") and base_spans(t) == ""

    pieces = kept[-1].toPandas().sort_values(["doc_id", "start"])
    memo = packing.memo_of(tokenizer_path("word_bpe_49k.json"))
    for i, g in pieces.groupby("doc_id"):
        want = np.asarray([*memo.whole.encode(got[3][i], add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(g.ids) == want and all(zlib.crc32(x) == c for x, c in zip(g.ids, g.ids_crc32))
    assert set(pieces.doc_id) == set(got[3])


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SRC)
    assert out.agg({"length": "sum"}).first()[0] == out.select("doc_id", "doc_tokens").distinct().agg({"doc_tokens": "sum"}).first()[0]

"""Each stage against a plain version of its decision on its own input, and the whole against the stages one by one."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from screenlens.llm import packing, toxicity
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import check_packed
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and result, in order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = []
    for name, stage in corpus_pipeline.STAGES:
        result = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        found.append((name, docs, result))
        docs = result
    return {name: (before, after) for name, before, after in found}


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_drops_what_it_scores_toxic(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    said = {r.doc_id for r in toxicity.toxicity(before, labels).collect() if r.predicted}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == said
    kept = {r.doc_id: r for r in after.collect()}
    assert all(kept[r.doc_id] == r for r in before.collect() if r.doc_id in kept)


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    want = {d: text for d, _, _, text in brute_lines([(r.doc_id, r.text) for r in before.collect()])}
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_one_document_of_each_group_stays(stages):
    before, after = stages["simhash_dedup"]
    marked = [(r.doc_id, plain_fingerprint(r.text)) for r in before.collect()]
    keep = {d for (d, _), c in zip(marked, plain_components(marked), strict=True) if d == c}
    assert {r.doc_id for r in after.collect()} == keep


def test_decontamination_drops_what_holds_an_item(spark, stages):
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    squeezed = [" ".join(t.split()) for t in items]
    leaks = {r.doc_id for r in before.collect() if any(t in " ".join((r.text or "").split()) for t in squeezed)}
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert leaks <= gone and len(gone) <= len(leaks) + 3


def test_packing(stages):
    before, after = stages["packing"]
    check_packed([(r.doc_id, r.text) for r in before.collect()], after.collect(), packing.CAPACITY)


def test_run_is_the_stages_in_order(spark, stages):
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages["packing"][1].collect()))


def test_every_stage_takes_odd_rows(spark):
    rows = [(None, "null id", None, None, None), (1, None, None, None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    rows += [(3, "x " * 100_000, "en", "s", 7), (-4, "long line of text\n" * 5, "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for odd in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, odd, SF)
            found.collect()
        assert zlib.crc32(np.array([2], "<u4").tobytes()) in {r.ids_crc32 for r in found.collect()} or not odd.count()

"""The pipeline's stages: what they return, and odd and empty inputs."""

import pytest

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_operators import COLUMNS, ODD, check_packing
from tidemark.llm import decontaminate, kneser_ney, line_dedup, simhash
from tidemark.llm.common import table, written


def test_stages_on_their_own_input(spark):
    docs = table(spark, SF_SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "near_duplicates", "decontamination", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(spark, stage(spark, docs, SF_SMALL), name)
        assert out.columns == docs.columns
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, out))
        kept[name] = (before, after)
        docs, previous = out, docs
        if name == "quality_classifier":
            judged = kneser_ney.classify(spark, previous, table(spark, SF_SMALL, "labels")).collect()
            assert set(after) == {r.doc_id for r in judged if r.kept} < set(before)
        if name == "line_dedup":
            assert after == {r.doc_id: r.text for r in line_dedup.dedup_lines(spark, previous).collect()}
        if name == "near_duplicates":
            groups = simhash.near_duplicates(spark, previous).collect()
            assert set(after) == {r.component_id for r in groups} < set(before)
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.leaks(spark, previous, table(spark, SF_SMALL, "benchmark")).collect()}
            assert set(after) == set(before) - bad
    from tests.llm.test_operators import tokens
    import numpy as np
    enc = tokens.encoder(tokens.default_tokenizer())
    ids = {d: np.frombuffer(enc.encode([t or ""])[0], "<u4").tolist() + [0] for d, t in after.items()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    check_packing(packed, ids)
    assert sorted(map(tuple, packed), key=repr) == sorted(map(tuple, _same(spark)), key=repr)


def _same(spark):
    """run() packs the same pieces, whatever partitions they are in."""
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.collect()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_no_rows(spark, name, stage):
    odd = spark.createDataFrame(ODD, COLUMNS).selectExpr("*", "1L AS n_chars", "1 AS fp", "2 AS text_key", "3 AS kept", "4 AS codes")
    out = stage(spark, odd, SF_SMALL)
    assert out.count() > 0 and (name == "packing" or out.columns == odd.columns)
    assert stage(spark, odd.limit(0), SF_SMALL).count() == 0

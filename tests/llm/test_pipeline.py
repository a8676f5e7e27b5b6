import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from codegauge.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from codegauge.llm.queries import QUERIES


def test_ten_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "secret scan", "packing"]


@pytest.fixture
def table(spark, docs, words, tmp_path):
    texts = [" ".join(words(60, seed=i)) for i in range(30)]
    pairs = [(i, t, "en") for i, t in enumerate(texts)]
    pairs += [(100, texts[0].replace(" ", "  "), "en"), (101, texts[1] + " tail", "en"), (102, None, None), (103, "123", "en"), (104, " ".join(words(50, seed=77)) + " token = 'abcdefghijklmnopqrst'", "en")]
    docs(pairs).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), dict((i, t) for i, t, _ in pairs)


def test_stages_against_their_inputs(spark, table):
    folder, texts = table
    d = spark.read.parquet(f"{folder}/documents.parquet")
    columns = d.columns
    keep = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, folder)
        if name != "packing":
            assert out.columns == columns
        at = f"{folder}/stage{k}"
        out.write.parquet(at)
        d = spark.read.parquet(at)
        keep[name] = {r.doc_id: r for r in d.collect()}
    assert set(texts) - set(keep["language ID"]) == {102, 103}
    assert set(keep["language ID"]) - set(keep["exact dedup"]) == {0}  # 100 is longer
    assert set(keep["exact dedup"]) - set(keep["near dedup"]) == {101}
    assert set(keep["secret scan"]) == set(keep["near dedup"]) and secret_scan.MASK in keep["secret scan"][104].text
    assert set(keep["packing"]) == set(keep["secret scan"])


def test_run_gives_all_ids_of_what_is_kept(spark, table):
    folder, texts = table
    pieces = corpus_pipeline.run(spark, folder).collect()
    w = packing.words(packing.TOKENIZER)
    got = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        got.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, "<u4"))
    assert set(got) == set(texts) - {0, 101, 102, 103}
    for i in set(got) - {104}:
        assert got[i] == [*w.tokenizer.encode(texts[i], add_special_tokens=False).ids, 1]


def test_stage_functions_call_the_operators():
    assert corpus_pipeline.keep_known is language_id.keep_known and corpus_pipeline.keep_first is exact_dedup.keep_first
    assert corpus_pipeline.keep_one is near_dedup.keep_one and corpus_pipeline.redact is secret_scan.redact and near_dedup.WORDS == 5

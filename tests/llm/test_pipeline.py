"""The pipeline's stages on their own input, against plain versions, and the registered queries against SQL."""

import pytest

import corpus_pipeline
from compare import difference, duck
from meterline.llm import language, mixing, quality, registry, sentence_pieces
from meterline.llm.common import table
from test_near_duplicates import brute


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := str(tmp_path / name))
        seen[name] = (docs.collect(), spark.read.parquet(path).collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)

    before, after = seen["quality"]
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    difference_of = quality.Difference(model.good, model.bad)
    kept = {r.doc_id for r in before if quality.sigmoid(model.slope * difference_of(r.text) + model.offset) >= 0.5}
    assert {r.doc_id for r in after} == kept and 0 < len(kept) < len(before)

    before, after = seen["language"]
    parser = language.Parser(language.teach(spark.read.parquet(str(tmp_path / "quality"))))
    found = language.judge(parser, [r.text for r in before])
    assert {r.doc_id for r in after} == {r.doc_id for r, f in zip(before, found) if f["lang"] != "und" and f["match"] >= language.LEAST_MATCH}

    before, after = seen["near_duplicates"]
    assert {r.doc_id for r in after} == {i for i, v in brute([(r.doc_id, r.text) for r in before], 5).items() if v[2]}
    assert len(after) < len(before)

    before, after = seen["mixing"]
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(spark.read.parquet(str(tmp_path / "near_duplicates"))).collect()}
    assert sorted(r.doc_id for r in after) == sorted(i for i, n in plan.items() for _ in range(n))

    before, after = seen["sentence_pieces"]
    codec = sentence_pieces.codec()
    assert sorted((r.doc_id, r.ids) for r in after) == sorted((r.doc_id, codec.encode(r.text)) for r in before)
    assert all(codec.decode(r.ids) == r.text and r.n_ids == len(r.ids) for r in after)


def test_run_repeats(spark, sf_dir):
    rows = [sorted((r.doc_id, r.n_ids) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_stages_take_empty_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []


@pytest.mark.parametrize("key", sorted(registry.SQL))
def test_sql(spark, sf_dir, key):
    assert difference(registry.QUERIES[key](spark, sf_dir), duck(sf_dir), registry.SQL[key]) is None


def test_query_names():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))

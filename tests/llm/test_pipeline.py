"""The pipeline's stages in a row, each against a plain form of itself on what it was given."""

import corpus_pipeline
import pytest
from samples import docs, rows, texts  # noqa: F401
from test_corpus_operators import classes_of, normalised, plain_fingerprint
from test_text_operators import base_spans, measures


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory, docs):
    folder = tmp_path_factory.mktemp("pipeline")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(names).write.parquet(f"{folder}/documents.parquet")
    out = [[tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(names).collect()]]
    given = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, str(folder)).write.parquet(f"{folder}/{k}")
        given = spark.read.parquet(f"{folder}/{k}")
        if name != "best_fit_packing":
            assert given.columns == names
        out.append([tuple(r) for r in given.collect()])
    return out, folder


def test_stages(stages):
    (docs, clean, exact, near, masked, packed), _ = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "exact_dedup", "simhash_near_dedup", "personal_data", "best_fit_packing",
    ]

    def passes(text):
        n, _, _, _, repeats = measures(text)
        return n >= 50 and 100 * repeats <= 50 * n

    assert set(clean) <= {r for r in docs if passes(r[1])}
    assert {normalised(r[1]) for r in exact} == {normalised(r[1]) for r in clean}
    assert len(exact) == len({normalised(r[1]) for r in exact})
    root = classes_of({plain_fingerprint(r[1]) for r in exact})
    least = {}
    for r in exact:
        p = root[plain_fingerprint(r[1])]
        least[p] = min(least.get(p, r[0]), r[0])
    assert sorted(r[0] for r in near) == sorted(least.values())
    assert {r[0] for r in masked} == {r[0] for r in near}
    for r in masked:
        assert base_spans(r[1]) == [] and r[4] == len(r[1])
    assert {r[0] for r in packed} == {r[0] for r in masked}


def test_run(spark, stages):
    (*_, packed), folder = stages
    assert corpus_pipeline.run(spark, str(folder)).count() == len(packed)

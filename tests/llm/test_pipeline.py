import pytest
from samples import no_docs, odd_docs

import __spark_entry__ as entry_points
import corpus_pipeline
from tripkit.llm import quality, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns, written and read again."""
    docs, made = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(n))
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        made.append(docs)
    return made


def test_decisions_take_effect(spark, stages):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    good, clean, distinct, mixed, encoded = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    scored = quality.with_quality(docs, quality.fit_quality(docs, labels))
    assert sorted(good.collect()) == sorted(scored.where("score >= 0.3").drop("score").collect())
    scored = toxicity.with_toxicity(good, toxicity.fit_toxicity(good, labels))
    assert sorted(clean.collect()) == sorted(scored.where("score < 0.7").drop("score").collect())
    sets = {}
    for r in sorted(clean.collect()):
        mine = set(simhash.shingle_hashes(r.text.encode().lower().split(), 5).tolist())
        if not any(len(mine & s) >= 0.8 * len(mine | s) for s in sets.values()):
            sets[r.doc_id] = mine
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(sets)
    assert {r.doc_id for r in mixed.collect()} <= set(sets)
    texts = sorted((r.doc_id, r.text.encode()) for r in mixed.collect())
    assert sorted((r.doc_id, bytes(r.decoded)) for r in encoded.collect()) == texts


def test_run_is_registered_and_gives_the_last_stage(spark, stages):
    assert entry_points.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(rows) == sorted(stages[-1].collect())


def test_near_duplicates_join_what_op10_links(spark):
    # 212 is within two bits of 3 and others, at a Jaccard similarity of 0.74.
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 500").coalesce(4)
    firsts = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs, words=3).collect()}
    assert firsts[3] == firsts[212] == 3
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()]
    assert 3 in kept and 212 not in kept
    assert all(firsts[i] == i for i in kept)


@pytest.mark.parametrize("docs", [odd_docs, no_docs])
def test_every_stage_takes_odd_rows(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs(spark), FOLDER)
        assert made.columns == docs(spark).columns
        made.collect()
    corpus_pipeline.STAGES[-1][1](spark, docs(spark), FOLDER).collect()

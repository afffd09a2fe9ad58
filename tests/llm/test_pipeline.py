"""Every stage of the corpus pipeline against plain versions, each on its own input."""

import pytest

import corpus_pipeline
from capacast import session
from capacast.llm import language

from . import brute

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of every stage by name."""
    docs = brute.sample_documents(spark, FOLDER)
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        after = session.materialise(stage(spark, docs, FOLDER), name)
        found[name] = (docs, after)
        docs = after
    return found


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_stage_names_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_dedup", "substring_dedup", "decontamination", "source_mix"]
    wanted = brute.sample_documents(spark, FOLDER).dtypes
    for name, (before, after) in stages.items():
        assert before.dtypes == wanted
        assert after.dtypes[:len(wanted)] == wanted


def test_language(spark, stages):
    before, after = stages["language_id"]
    rows = language.from_documents(before)
    verdicts = {r.id: r.kept for r in language.identify(rows, language.fit(rows)).collect()}
    assert set(texts(after)) == {d for d, kept in verdicts.items() if kept}
    assert after.count() > 0.99 * before.count()


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    wanted = {c for _, c in brute.components(texts(before).items()).values()}
    assert set(texts(after)) == wanted and after.count() == len(wanted)


def test_substrings(stages):
    before, after = stages["substring_dedup"]
    wanted = {d: kept for d, (n, kept) in brute.kept_words(texts(before).items()).items() if kept or not n}
    found = {r.doc_id: r for r in after.collect()}
    assert {d: brute.words(r.text) for d, r in found.items()} == wanted
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    flat = {d: " ".join(t.lower().split()) for d, t in texts(before).items()}
    leaking = {d for d, t in flat.items() if any(i in t for i in items)}
    gone = set(flat) - set(texts(after))
    assert leaking <= gone and leaking
    for d in gone - leaking:  # long stretches of an item must be in the others that went
        assert any(sum(" ".join(w[i:i + 4]) in flat[d] for i in range(len(w) - 3)) >= 0.35 * (len(w) - 3)
                   for w in map(str.split, items))


def test_mix(stages):
    before, after = stages["source_mix"]
    ids, mixed = texts(before), after.collect()
    assert {r.doc_id for r in mixed} <= set(ids) and all(r.text == ids[r.doc_id] for r in mixed)
    assert abs(len(mixed) - len(ids)) < 5 * len(ids) ** 0.5


def test_run_gives_the_last_stage(spark, stages):
    _, after = stages["source_mix"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, after.collect()))


def test_odd_rows(spark):
    docs = brute.odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER)
        if name != "source_mix":
            assert after.columns == docs.columns
        for r in after.collect():  # what is none of the stage's business comes back as it was
            others = {c: r[c] for c in docs.columns if c not in brute.DOCUMENTS and c != "copy"}
            assert set(others.values()) in ({"7", 7}, {None})
        empty = stage(spark, brute.empty_documents(spark), FOLDER)
        assert empty.count() == 0
    kept = corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5, 5, 6, 7]
    assert [r.text for r in kept if r.doc_id is None] == ["Text without an id"]


def test_near_dedup_never_broadcasts_the_kept_ids(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of its own {i * 7919} words") for i in range(9)],
                                 "doc_id bigint, text string")
    for rows in (docs, docs.union(docs.limit(1))):
        kept = corpus_pipeline.near_dedup(spark, rows, "")
        assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()

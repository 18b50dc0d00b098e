import test_lines
import test_mixing
import test_neardup

import corpus_pipeline
from ballotcredit.llm import toxicity
from ballotcredit.llm.decontam import find_leaks

SF = "/root/testdata/sf0.001"


def test_each_stage_does_its_work_on_all_its_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        state[name] = (before, docs)
        if name != "source_mix":
            assert docs.columns == columns

    def ids(frame):
        return {r.doc_id for r in frame.select("doc_id").collect()}

    before, after = state["toxicity"]
    machine = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == {r.doc_id for r in before.collect() if machine.score(r.text) < 0.5}
    before, after = state["line_dedup"]
    want = {i: t for i, _, _, t in test_lines.brute(
        [(r.doc_id, r.text) for r in before.collect()], 10, 1)}
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {
        i: (t, len(t)) for i, t in want.items()}
    before, after = state["near_dedup"]
    assert ids(after) == {i for i, _, _, kept in test_neardup.brute(
        [(r.doc_id, r.text) for r in before.collect()]) if kept}
    before, after = state["decontamination"]
    leaks = find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(after) == ids(before) - ids(leaks)
    before, after = state["source_mix"]
    rows = [(r.doc_id, r.text, r.source) for r in before.collect()]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.encode().split())
    want = test_mixing.targets(sizes)
    taken = {}
    for r in after.collect():
        assert 0 < r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken.get(s, 0) - want[s]) <= 64 for s in want)
    got = corpus_pipeline.run(spark, SF)
    assert sorted(got.select("doc_id", "taken").collect()) == sorted(
        after.select("doc_id", "taken").collect())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0

"""The pipeline, stage by stage, against plain statements of each stage's effect."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from quotelens.llm import compression, decontamination, ngram_join
from quotelens.llm.line_dedup import emptied_removed, line_dedup

from test_operators import HOSTILE, LABELS, frame

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        outs.append((docs, docs := spark.read.parquet(str(tmp_path / str(k)))))
    assert all(out.columns == names for _, out in outs[:-1])
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    scored = compression.quality(outs[0][0], labels)
    assert ids(outs[0][1]) == ids(scored.where("predicted = 1"))
    cut = line_dedup(outs[1][0]).where("n_removed = 0 or n_removed < n_lines")
    assert sorted(map(tuple, cut.select(*names).collect())) == sorted(map(tuple, outs[1][1].collect()))
    texts = {r["doc_id"]: r["text"] for r in outs[2][0].collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in texts.items()}
    kept = {r["doc_id"] for r in outs[2][1].collect()}
    near = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    assert all(any(near(a, b) for b in sets if b != a) for a in set(texts) - kept)
    found = decontamination.decontaminate(outs[3][0], bench)
    assert set(ids(outs[3][1])) == set(ids(outs[3][0])) - set(ids(found))
    last = outs[4][1].toPandas()
    assert sorted(last["doc_id"]) == ids(outs[4][0]) and (last["taken"] <= 2 * last["size"]).all()
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, outs[4][1].collect()))
    assert ngram_join.JoinConfig(5, 80).percent == 80


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_line_dedup_leaves_no_shuffle_files_to_the_next_stage(spark):
    """Its frame may be held while the next stage runs; shuffle files of the whole texts would be held with it."""
    out = dict(corpus_pipeline.STAGES)["line dedup"](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    assert out.count() and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


LONG = "".join(f"w{i % 977} " if i % 50 else f"line {i}\n" for i in range(400_000))  # over 1 MiB
STAGE_FUNCTIONS = {
    "quality classifier": (lambda s, d: compression.rejected_removed(d, s.createDataFrame([(3, 1, 0), (4, 0, None), (None, 1, 1)], LABELS)), None),
    "line dedup": (lambda s, d: emptied_removed(d), set()),
    "n-gram Jaccard join": (lambda s, d: ngram_join.near_duplicates_removed(d, ngram_join.JoinConfig(k=5, percent=80)), None),
    "benchmark decontamination": (lambda s, d: decontamination.leaked_removed(d, s.createDataFrame([(1, None), (2, ""), (3, "same text here again and again")], "item_id long, text string")), {"same text here again and again"}),
}


@pytest.mark.parametrize("name", STAGE_FUNCTIONS)
def test_stages_on_hostile_input(spark, name):
    """Nulls, repeated ids and rows, empty and very long texts, clashing column names, an empty table."""
    stage, gone = STAGE_FUNCTIONS[name]
    rows = [*HOSTILE, (10, LONG), (10, "another text under one id")]
    docs = frame(spark, rows, extra=True)
    out = stage(spark, docs)
    assert out.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"] if r["doc_id"] not in (9, 10) else None) for r in out.collect())
    every = Counter((i, t if i not in (9, 10) else None) for i, t in rows)
    assert not kept - every
    if gone is not None:
        assert kept == Counter({k: n for k, n in every.items() if k[1] not in gone})
    assert (10, None) in kept
    assert stage(spark, frame(spark, [], extra=True)).count() == 0

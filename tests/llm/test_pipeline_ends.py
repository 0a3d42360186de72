"""The pipeline's last stage on odd rows, and the whole of it on a small folder and on empty tables."""

from collections import defaultdict

import corpus_pipeline

BENCH = "item_id long, text string"


def test_packing_stage(spark, docs, data, none, tmp_path):
    packing = corpus_pipeline.STAGES[-1][1]
    out = packing(spark, docs, str(tmp_path)).collect()
    assert packing(spark, none, str(tmp_path)).count() == 0
    pieces = defaultdict(list)
    for r in out:
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in pieces.values():  # gapless from 0, and no longer than a sequence
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert {r["doc_id"] for r in out} == {r[0] for r in data}


def test_pipeline_on_small_folders(spark, docs, none, tmp_path):
    for name, given in (("some", docs), ("empty", none)):
        given.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items = [(1, "one two three four five six seven eight nine ten eleven"), (2, None)] if name == "some" else []
        spark.createDataFrame(items, BENCH).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert (out.count() > 0) == (name == "some") and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)

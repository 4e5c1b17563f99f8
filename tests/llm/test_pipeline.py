"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_spans, split

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs, spark.read.parquet(str(tmp_path / name))
        docs = seen[name][1]
        assert name == "best_fit_packing" or docs.columns == columns
    texts = lambda df: {r.doc_id: r.text or "" for r in df.collect()}
    before, after = map(texts, seen["quality_rules"])
    assert 0 < len(after) < len(before) and all(set(t.split("\n")) <= set(before[d].split("\n")) for d, t in after.items())
    before, after = map(texts, seen["quality_classifier"])
    assert after.items() <= before.items() and len(after) > 0.8 * len(before)
    before, after = map(texts, seen["near_dedup"])
    want = brute_components(before, 5)[1]
    assert after == {d: t for d, t in before.items() if want[d] == d}
    before, after = map(texts, seen["substring_dedup"])
    w, gone = brute_spans(before, 20)
    assert {d: split(t) for d, t in after.items()} == {d: [y for i, y in enumerate(x) if i not in gone.get(d, ())] for d, x in w.items()}
    docs, packed = seen["best_fit_packing"]
    assert {r.doc_id for r in packed.collect()} == set(after)

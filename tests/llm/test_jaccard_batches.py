"""Batches of equal content in the n-gram Jaccard join."""

from loomgraph.llm import jaccard_join


def test_equal_batches_stay_apart(spark, tmp_path):
    texts = [" ".join(f"w{k * 50 + i}" for i in range(40)) for k in range(3)]
    rows = spark.createDataFrame([(None, t) for t in texts] + [(7, texts[0])], "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/once")
    twice = spark.read.parquet(f"{tmp_path}/once", f"{tmp_path}/once")
    assert twice.rdd.getNumPartitions() == 2
    found = jaccard_join.similarity_components(twice, 4, 85).collect()
    assert len(found) == 8 and {r.n_shingles for r in found} == {37}
    assert sorted(str(r.component_id) for r in found) == ["7"] * 4 + ["None"] * 4

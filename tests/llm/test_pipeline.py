from pyspark.sql import functions as F

import corpus_pipeline as P
from kugiri.llm import core, packing

from .test_jaccard import brute


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = docs.collect()
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "quality", "near duplicates", "packing"]
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(P.STAGES[:-1]):
        out = core.written(stage(spark, df, str(tmp_path)))
        assert out.columns == docs.columns
        df = out
        ids = {r.doc_id for r in df.collect()}
        if i == 0:
            assert ids == {r.doc_id for r in rows} - set(range(80, 100))
        if i == 1:
            assert set(range(60)) - ids == set() or len(set(range(60)) - ids) <= 2
            assert len(ids & set(range(100, 130))) <= 3
            before = [(r.doc_id, r.text) for r in df.select("doc_id", "text").distinct().collect()]
        if i == 2:
            assert ids == {i for i, (least, _) in brute(before, 0.5)[1].items() if i == least} | ({None} & {i for i, _ in before})
    want = packing.pack(df).collect()
    got = P.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r.doc_id for r in got} == {r.doc_id for r in df.collect() if r.text and r.text.strip("!? ")}


def test_stages_with_clashing_columns(spark, docs, clashing, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    more = clashing.select("*", *(F.lit("x").alias(c) for c in ("a", "b", "class_id", "n_links", "good", "s", "family")))
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, more, str(tmp_path))
        assert got.columns == more.columns
        kept = lambda df: sorted(repr((r.doc_id, r.text and r.text[:80])) for r in df.select("doc_id", "text").collect())
        assert kept(got) == kept(stage(spark, docs, str(tmp_path)))


def test_empty_tables(spark, none, tmp_path):
    none[0].write.parquet(f"{tmp_path}/documents.parquet")
    none[1].write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0

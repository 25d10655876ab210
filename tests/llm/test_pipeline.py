"""The pipeline on a small table."""

import __spark_entry__ as entry
import corpus_pipeline


def test_entry_has_every_query():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns, name
        assert kept.join(before, "doc_id", "left_anti").isEmpty() and 0 < kept.count() <= before.count(), name
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.select("doc_id").distinct().count() == kept.count()
    assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").isEmpty()


def test_pipeline_edges(spark, sf_dir, tmp_path):
    """Nulls, repeated ids with the same and other texts, extra columns, and an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = docs.filter("length(text) > 400").orderBy("doc_id").limit(2).collect()
    text, other = long[0]["text"], long[1]["text"]
    row = lambda doc, t: (doc, t, "en", "web", None)
    more = spark.createDataFrame([row(9_000_001, text), row(9_000_001, text), row(9_000_002, other), row(9_000_002, other + " and one more sentence of its own"), row(None, text), row(None, None), row(9_000_003, None), row(9_000_004, "")], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    own = stages["ngram_jaccard_join"](spark, more, sf_dir).collect()
    left = sorted(((r["doc_id"] or 0), (r["text"] or "")[:20]) for r in own)
    # One row of the three equal texts, one of the near pair, and all rows without words.
    assert left == sorted([(9_000_001, text[:20]), (9_000_002, other[:20]), (0, ""), (9_000_003, ""), (9_000_004, "")])
    whole = docs.unionByName(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, whole, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= whole.count(), name
        nothing = stage(spark, whole.limit(0), sf_dir)
        assert nothing.columns == docs.columns and nothing.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, whole.limit(0), sf_dir).count() == 0

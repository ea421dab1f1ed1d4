from pyspark.sql import functions as F

import corpus_pipeline
from swingkit.llm import jaccard, packing, quality, rules
from swingkit.llm.common import id_remainder, table

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    """Each stage keeps the rows that its operator's own decisions, joined by id on the driver, keep."""
    docs = table(spark, SF, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near-dedup", "packing"]
    labels = table(spark, SF, "labels")
    model = quality.fit(docs, labels.filter(id_remainder(labels["doc_id"], 4) != 2))
    good = {r.doc_id for r in docs.collect() if model.score(quality.features(r.text)) >= 0.7}
    first = corpus_pipeline.classify(spark, docs, SF)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == good
    verdict = {r.doc_id for r in rules.apply_rules(first, labels).select("doc_id", "kept").collect() if r.kept}
    second = corpus_pipeline.apply_rules(spark, first, SF)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == verdict
    groups = {r.component_id for r in jaccard.near_duplicates(second).collect()}
    third = corpus_pipeline.drop_copies(spark, second, SF)
    assert third.columns == docs.columns and sorted(r.doc_id for r in third.collect()) == sorted(groups)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == groups
    assert max(r.offset + r.length for r in packed) <= packing.WINDOW


def test_repeated_and_null_ids_and_no_rows(spark):
    """Rows of one doc_id with other texts stay, exact and near copies go by row, whatever their ids."""
    rows = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "r", 7), (2, "a b c d", "en", "s", 7), (None, "a b c d", "en", "s", 7), (3, "w x y z q", "en", "s", 9), (3, "own text", "en", "s", 9), (None, "other", "en", "s", 9), (None, "other", "en", "s", 9), (4, None, None, None, None), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    kept = sorted(((r.doc_id, r.text, r.source) for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()), key=str)
    assert kept == sorted([(1, "a b c d", "r"), (3, "w x y z q", "s"), (3, "own text", "s"), (None, "other", "s"), (4, None, None)], key=str)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_clashing_columns_keep_their_values(spark):
    extra = ["score", "kept", "llr", "n_words", "_text", "_key", "h", "n"]
    docs = table(spark, SF, "documents").withColumns({c: F.lit(f"own {c}") for c in extra})
    for stage in (corpus_pipeline.classify, corpus_pipeline.apply_rules, corpus_pipeline.drop_copies):
        docs = stage(spark, docs, SF)
        assert docs.columns[-8:] == extra
        assert [tuple(r) for r in docs.select(extra).distinct().collect()] == [tuple(f"own {c}" for c in extra)]

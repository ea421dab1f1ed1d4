"""Training corpus pipeline: quality classifier, quality rules, near-dedup and packing, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingkit.llm import jaccard, packing, quality, rules
from swingkit.llm.common import bounded, id_remainder, new_folder, table, unused

#: Up to so many ids of dropped copies are broadcast; more are joined by a shuffle.
MOST_COPIES = 2_000_000


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score reaches the cut."""
    labels = table(spark, sf_dir, "labels").filter(id_remainder(F.col("doc_id"), 4) != 2)
    name = unused(docs, "score")
    scored = quality.score(docs, quality.fit(docs, labels), name=name)
    return scored.filter(F.col(name) >= quality.CUT).select(docs.columns)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the likelihood ratio, with their own columns whatever the names."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("document"))
    return rules.apply_rules(rows, table(spark, sf_dir, "labels")).filter("kept").select("document.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every component of texts whose 5-word Jaccard similarity is 0.8 or more.

    It is the row of the least doc_id (a null one last), then of the least hash of the text; of rows equal in both, the
    least in the other columns. Rows are told apart by doc_id and text, so texts that share an id don't stand for each other.
    """
    found = jaccard.near_duplicates(docs.select("doc_id", "text"))
    rows = found.groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
    rows = rows.withColumn("row", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h"))
    firsts = rows.groupBy("root").agg(F.min("row").alias("first"))
    judged = rows.join(firsts, "root").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), (F.col("n") > 1).alias("again"), (F.col("row") == F.col("first")).alias("stays"))
    verdicts = spark.read.parquet(_written(judged.filter("again or not stays"), "copies"))
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_h"))
    single = docs.join(bounded(verdicts, MOST_COPIES), same, "left_anti")
    repeated = docs.join(bounded(verdicts.filter("stays"), MOST_COPIES), same, "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = repeated.groupBy("doc_id", "text").agg(F.min(F.struct(*others, F.lit(0))).alias("other")).select("doc_id", "text", *(F.col("other")[c].alias(c) for c in others))
    return single.unionByName(once).select(docs.columns)


def _written(df: DataFrame, name: str) -> str:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(docs, packing.default_path()))


STAGES = [("quality classifier", classify), ("quality rules", apply_rules), ("near-dedup", drop_copies), ("packing", pack)]

#: The first stage fits a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = spark.read.parquet(_written(docs, f"stage{k}"))
    return docs

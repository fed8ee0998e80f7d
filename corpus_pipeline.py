"""From raw documents to token ids: five stages, each on all that its predecessor kept.

Quality rules drop failing documents; line dedup shortens texts; of each group of
near duplicates one row stays, the first by doc_id (null comes last) and text;
documents that hold a benchmark item go; the rest is encoded.

Rows are told apart by marks of their own, never by doc_id: a null doc_id is like
any other, and rows that share a doc_id are judged by their own texts.  Texts
without words are near duplicates of nothing; of equal rows of them one stays.
A null or empty text fails the first stage.  Texts are read whole, however long.
Only the columns of documents (and item_id and text of benchmark) are read; others,
whatever their names, never matter, and nulls in lang, source and n_chars stay.  An
empty table of documents gives no rows; without benchmark items no document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from maploom.llm.quality import keep_good

    return keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from maploom.llm.line_dedup import line_dedup as dedup

    out = dedup(docs, columns=COLUMNS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from maploom.llm.common import Workspace, release
    from maploom.llm.jaccard_join import jaccard_join

    work = Workspace(spark, "near")
    docs = work.save(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = jaccard_join(docs.select(F.col("_row").alias("doc_id"), "text"))
    found = work.save(found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("component"), (F.col("n_shingles") > 0).alias("worded")), "components")
    rows = docs.select("_row", "doc_id").join(found, "_row")
    # of a component's rows those with the first doc_id; texts are compared only where that is not a single row
    place = F.struct(F.col("doc_id").isNull(), "doc_id")
    least = rows.where("worded").groupBy("component", "doc_id").agg(F.min("_row").alias("_row"), F.count("*").alias("n")).groupBy("component").agg(F.min_by(F.struct("doc_id", "_row", "n"), place).alias("x"))
    least = work.save(least.select("component", "x.*"), "least")
    kept, tied, blank = least.where("n = 1").select("_row"), least.where("n > 1"), found.where("not worded").select("_row")
    if not tied.isEmpty():
        tied = tied.select(F.col("component").alias("c"), F.col("doc_id").alias("id"))
        tied = rows.where("worded").join(tied, F.expr("component = c and doc_id <=> id")).select("_row", "component").join(docs.select("_row", "text"), "_row")
        kept = kept.unionByName(tied.groupBy("component").agg(F.min(F.struct("text", "_row")).alias("x")).select("x._row"))
    if not blank.isEmpty():
        kept = kept.unionByName(docs.join(blank, "_row", "left_semi").groupBy("doc_id", "text").agg(F.min("_row").alias("_row")).select("_row"))
    release(spark)
    return docs.join(kept, "_row", "left_semi").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from maploom.llm.decontaminate import clean

    return clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from maploom.llm.sentencepiece_codec import encode

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_crc32", "round_trip", "n_differ")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]
#: The first and the last stage are not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is saved and read again."""
    from maploom.llm.common import Workspace

    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = work.save(docs, f"stage-{k}")
    return docs

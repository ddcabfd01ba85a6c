"""From raw documents to token ids in five stages, each of which works on what the one before it kept.

Near-duplicate removal goes by rows, whatever their ids: one row of each group stays. A document whose lines are all
dropped stays with an empty text; rows without a word are in no group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loppis.llm import bpe, decontaminate, jaccard, linededup, quality
from loppis.llm.common import WORD, cut, table
from loppis.llm.queries import vocabulary
from loppis.operators.writes import first_by


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language and source go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all texts; n_chars follows."""
    done = linededup.cleaned(docs, min_docs=10)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group linked at 80 per cent of five-word shingles: that of the smallest id, nulls last,
    then by a hash of the text."""
    has_word = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    # rows equal in id and text share a key; the hash's length is fixed, so no two ids and texts give one name
    name = F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-")), F.sha2("text", 256))
    keyed = docs.filter(has_word).withColumn("_row", F.sha2(name, 256))
    found = jaccard.join(keyed.select("_row", "text"), size=5, percent=80, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id").distinct()
    ids = keyed.select("_row", "doc_id").distinct().join(found, "_row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least")).select("least._row")
    kept = first_by(keyed.join(first, "_row", "left_semi"), ["_row"], [F.col("_row")])
    return kept.select(*docs.columns).unionByName(docs.filter(~has_word))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), width=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids as little-endian unsigned 32-bit integers."""
    return bpe.round_trip(docs, vocabulary(), id_cols=("doc_id", "lang", "source")).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Covariance estimates and BPE merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, cut in the shared checkpoint folder after each stage but the last."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs

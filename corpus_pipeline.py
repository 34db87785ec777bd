"""From raw documents to a mix of sources: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last adds how often each one is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import decontaminate, mixing, near_dups, personal_data, toxicity
from rankweave.llm.queries import table
from rankweave.llm.rows import named, unpacked
from rankweave.llm.scratch import Scratch


def whole_rows(docs: DataFrame) -> DataFrame:
    """Every row in one struct beside the columns that the operators read, so that no operator's column clashes with one of its own."""
    return docs.select(F.struct(*(named(c).alias(c) for c in docs.columns)).alias("doc"), "doc_id", "text")


def rows_of(kept: DataFrame) -> DataFrame:
    """The rows again, with the columns that they had."""
    return kept.select(*unpacked(kept, "doc"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the toxicity model does not reject, null and empty texts too."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rest = F.struct(*(named(c).alias(c) for c in docs.columns if c != "text"))
    kept = toxicity.score_documents(docs.select(rest.alias("doc"), "text"), model, carry=["doc", "text"]).where("predicted = 0")
    return kept.select(*(F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group at a similarity of 0.8 on five-word shingles.

    Rows of one id are one document and stay or go together; rows without an id, and texts without words, stay.
    """
    groups = near_dups.near_duplicates(docs, k=5, percent=80)
    gone = groups.where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(named(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a passage of the benchmark."""
    found = decontaminate.find_leaks(whole_rows(docs), table(spark, sf_dir, "benchmark"), carry=["doc"])
    return rows_of(found.where("NOT contaminated"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in the place of every span of personal data, and count characters anew there; all documents stay."""
    found = personal_data.find_personal_data(whole_rows(docs), personal_data.train(spark), carry=["doc", "text"])
    some = F.size("spans") > 0
    clean = found.withColumn("text", personal_data.redact(F.col("text"), F.col("spans")))
    new = {"text": F.col("text"), "n_chars": F.when(some, F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))}
    return clean.select(*(new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document goes into the mix, and the words that it gives; columns of these names give way to the mix's."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: SQL can express neither the models nor the balancing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again before the next."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

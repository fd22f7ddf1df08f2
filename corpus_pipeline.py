"""The corpus pipeline: clean, deduplicate, decontaminate, mix and shard the documents.

Every stage takes all that the one before kept. Rows are passed on whole, in all columns of
``documents``; the last stage returns places in shards instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmatch.llm.decontamination import contamination
from pairmatch.llm.minhash import MOST_BROADCAST, near_duplicates
from pairmatch.llm.mixing import mixed
from pairmatch.llm.queries import CATEGORIES, is_contaminated, labelled_texts, load
from pairmatch.llm.ring import ring_shards
from pairmatch.llm.toxicity import classify, fit_chain
from pairmatch.operators.joins import lookup_join
from pairmatch.session import written

#: The later stages draw on random-looking hashes and fitted models, which SQL has no equal of.
ORACLE_SQL = None
#: Near copies share this percentage of their five-word shingles or more.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the chain calls toxic; those of low quality stay.

    The chain learns from the labels of the documents at hand; without labels nothing goes.
    """
    chain = fit_chain(labelled_texts(docs, load(spark, sf_dir, "labels")), CATEGORIES)
    return classify(docs, chain).where(~F.col("toxic")).select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    A row is named by its id and its text, so rows that share an id are judged each by their own
    text. Rows without id come after all others, and of rows that repeat an id and a text one stays.
    """
    no_id = F.col("doc_id").isNull()
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    key = F.struct(
        no_id.alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        digest.alias("digest"),
    )
    found = written(
        near_duplicates(
            docs.select(key.alias("key"), "text"), id_col="key", percent=NEAR_PERCENT
        ),
        "near-copies",
    ).withColumnRenamed("doc_id", "key")
    gone = written(found.where(~F.col("kept")).select("key").distinct(), "dropped")
    counts = found.groupBy("key").agg(F.count("*").alias("n"))
    keyed = docs.select(F.struct("*").alias("doc"), key.alias("key"))
    kept = lookup_join(
        keyed, gone, ["key"], counts, F.col("key"), how="left_anti", most=MOST_BROADCAST
    )
    twice = written(counts.where("n > 1").select("key"), "repeated")
    if twice.isEmpty():
        return kept.select("doc.*")
    # a repeated id is rare; partial aggregation thins out even very many repeats
    by = (["key"], counts, F.col("key"))
    once = lookup_join(kept, twice, *by, how="left_anti", most=MOST_BROADCAST)
    more = lookup_join(kept, twice, *by, how="left_semi", most=MOST_BROADCAST)
    return once.select("doc.*").unionByName(
        more.select("doc.*").dropDuplicates(["doc_id", "text"])
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more is benchmark text."""
    whole = docs.select(F.struct("*").alias("doc"), "text")
    found = contamination(whole, load(spark, sf_dir, "benchmark"), id_col="doc")
    return found.where(~is_contaminated()).select("doc_id.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, keep or leave out documents so that the sources get their shares."""
    taken = mixed(docs).where(F.col("reps") > 0)
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("reps")))).select("doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the mix into 16 shards of the same number of documents."""
    return ring_shards(docs, 16)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on all documents; each result is written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

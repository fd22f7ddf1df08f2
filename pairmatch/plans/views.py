"""The library's input tables, derived from the test tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairmatch.functions import text as T
from pairmatch.operators import features, pairs as P
from pairmatch.operators.grid import numbered
from pairmatch.session import written


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over the session's cores if the planned scan has fewer parts.

    A small table is read from one row group, and all that follows would be one task. A large
    one has more parts than cores, and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of the documents."""
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and the next one, with whole texts.

    Pairs of a labelled document are training pairs (``TR``), the others are to be scored
    (``TS``) and have no label.
    """
    docs = documents(spark, sf_dir)
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    first = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("qid1"),
        F.col("text").alias("question1"), F.col("quality").alias("is_duplicate"),
    )
    second = docs.select(
        (F.col("doc_id") - 1).alias("id"), F.col("doc_id").alias("qid2"),
        F.col("text").alias("question2"),
    )
    raw = first.join(second, "id").select(
        "id", "qid1", "qid2", "question1", "question2", "is_duplicate"
    )
    return raw.withColumn("type", P.type_of(F.col("is_duplicate")))


def cleaned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text pairs with cleaned texts."""
    return features.clean_pairs(text_pairs(spark, sf_dir))


def basic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text pairs with counts and overlap."""
    return features.basic_features(text_pairs(spark, sf_dir))


def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled text pairs with counts and overlap."""
    return basic_features(spark, sf_dir).where("type = 'TR'")


def token_columns() -> list[Column]:
    """Tokens of the cleaned texts."""
    return [T.tokenize(F.col(f"q{s}nopunct")).alias(f"tokens{s}") for s in (1, 2)]


def token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays of both sides."""
    return cleaned_pairs(spark, sf_dir).select("id", *token_columns())


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned tokens of every document."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", T.tokenize(T.clean_text(F.col("text"))).alias("tokens"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of a conversation and the next one; the last turn has no partner."""
    turns = load(spark, sf_dir, "conversations")
    first = turns.select("conv_id", "turn", F.col("text").alias("question1"))
    second = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("question2")
    )
    return first.join(second, ["conv_id", "turn"], "left")


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 0/1 label ``y`` and a probability ``p`` that grows with the text length."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic")
    n = F.col("n_chars").cast("double")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("y"), (n / (n + 2000)).alias("p")
    )


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores ``(id, type, sem_similarity, word_order_similarity)`` of the non-toxic documents."""
    n = F.col("n_chars").cast("double")
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = load(spark, sf_dir, "labels").where("toxic = 0").select("doc_id")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.lit("TR").alias("type"),
        (n / (n + 3000)).alias("sem_similarity"), (1000 / (n + 1000)).alias("word_order_similarity"),
    )


def word_vectors(words: DataFrame, embeddings: DataFrame) -> DataFrame:
    """A vector for most words: a digest of the word names the embedding, 1 in 16 has none."""
    n_vectors = embeddings.agg(F.count("*")).scalar()
    digest = F.md5(F.col("word").cast("binary"))
    number = F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")
    return (
        words.where(F.substring(digest, 8, 1) != "0")
        .select("word", F.pmod(number, n_vectors).alias("vec_id"))
        .join(embeddings.select("vec_id", F.col("embedding").alias("vector")), "vec_id")
        .select("word", "vector")
    )


def tokens_and_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Token arrays of the text pairs and the vectors of their words, both stored."""
    tokens = numbered(token_pairs(spark, sf_dir))
    return tokens, written(vectors_for(spark, sf_dir, tokens), "vectors")


def vectors_for(spark: SparkSession, sf_dir: str, tokens: DataFrame) -> DataFrame:
    """Word vectors for the words of token pairs."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A word once per batch, so few rows reach the aggregate."""
        for batch in batches:
            words = pc.unique(pa.concat_arrays([x.flatten() for x in batch.columns]))
            yield pa.RecordBatch.from_arrays([words.drop_null()], names=["word"])

    both = tokens.select("tokens1", "tokens2").where("tokens1 is not null and tokens2 is not null")
    words = both.mapInArrow(words_of, "word string").distinct()
    return word_vectors(words, load(spark, sf_dir, "embeddings"))


def taxonomy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``lemma`` and ``edge``: places (region, nation, supplier) and goods (type, brand).

    A brand sold in several types is one word with several senses. Both are stored, as the
    input tables they stand for would be.
    """
    region = load(spark, sf_dir, "region").select(
        F.lower("r_name").alias("word"),
        F.concat(F.lit("region:"), "r_regionkey").alias("synset"), F.lit("entity").alias("parent"),
    )
    nation = load(spark, sf_dir, "nation").select(
        F.lower("n_name").alias("word"),
        F.concat(F.lit("nation:"), "n_nationkey").alias("synset"),
        F.concat(F.lit("region:"), "n_regionkey").alias("parent"),
    )
    supplier = load(spark, sf_dir, "supplier").select(
        F.lower(F.replace("s_name", F.lit("#"), F.lit(""))).alias("word"),
        F.concat(F.lit("supplier:"), "s_suppkey").alias("synset"),
        F.concat(F.lit("nation:"), "s_nationkey").alias("parent"),
    )
    part = load(spark, sf_dir, "part")
    kind = part.select(
        F.lower("p_type").alias("word"), F.concat(F.lit("type:"), "p_type").alias("synset"),
        F.lit("part").alias("parent"),
    ).distinct()
    brand = part.select(
        F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("word"),
        F.concat(F.lit("brand:"), "p_type", F.lit(":"), "p_brand").alias("synset"),
        F.concat(F.lit("type:"), "p_type").alias("parent"),
    ).distinct()
    nodes = P.union_chunks([region, nation, supplier, kind, brand])
    top = part.select(F.lit("part").alias("child"), F.lit("entity").alias("parent")).distinct()
    edge = nodes.select(F.col("synset").alias("child"), "parent").unionByName(top)
    senses = Window.partitionBy("word").orderBy("synset")
    lemma = nodes.select("word", "synset", F.row_number().over(senses).alias("sense_no"))
    return written(lemma, "lemma"), written(edge, "edge")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, tokens1, tokens2)``: what an order and the next one contain, in words; stored."""
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    goods = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat(
            F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(" "), F.lower("p_type")
        ).alias("goods"),
    )
    place = (
        load(spark, sf_dir, "supplier")
        .join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.lower("n_name").alias("place"))
    )
    phrase = F.concat("goods", F.lit(" from "), "place")
    # an order has a handful of lines
    texts = (
        lines.join(goods, "l_partkey")
        .join(place, "l_suppkey")
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", phrase.alias("p")))).alias("s"))
        .select("l_orderkey", F.array_join(F.transform("s", lambda x: x["p"]), " ").alias("text"))
    )
    tokens = texts.select("l_orderkey", T.tokenize(F.col("text")).alias("tokens"))
    first = tokens.select(F.col("l_orderkey").alias("id"), F.col("tokens").alias("tokens1"))
    second = tokens.select(
        (F.col("l_orderkey") - 1).alias("id"), F.col("tokens").alias("tokens2")
    )
    return written(first.join(second, "id"), "sentences")

"""From documents to token ids: toxicity, language, near copies, benchmark passages, SentencePiece.

Every stage takes (spark, docs, sf_dir), works on all documents that it is given and returns those that stay, with
their columns; the last returns their token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hierspark.llm import decontaminate, langid, ngram_join, sentencepiece_bpe, toxic
from hierspark.llm.util import broadcast_up_to, stored, text_batches

BROADCAST_IDS = 2_000_000
#: Letters that a text needs to be judged by its cosine, and how many times the noise that cosine has to be.
LETTERS, NOISES = 40, 4.0
#: No query's rows can be written in SQL: the classifiers are learned and the ids follow from a keyed hash.
ORACLE_SQL = None


def without(docs: DataFrame, ids: DataFrame, key: Column | None = None) -> DataFrame:
    """The rows whose key is not listed.  A list of up to a counted two million ids is broadcast, a longer one shuffled."""
    listed = broadcast_up_to(ids.select(F.col("doc_id").alias("__out")).distinct(), BROADCAST_IDS)
    return docs.join(listed, (F.col("doc_id") if key is None else key) == F.col("__out"), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels of these documents, does not call toxic."""
    text_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxic.learn(toxic.labelled(docs, labels))
    scored = toxic.score(docs, lexicon, keep=tuple(c for c in docs.columns if c != "doc_id"), prefix="__")
    return scored.where("__predicted = 0").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that resemble a language of these documents; those without letters, or like none, go.

    The cosine of a text that has nothing in common with a prototype is noise of about 1 / sqrt(dim), 0.031 here.  A text of
    40 letters or more has to reach four times that with its best prototype.  Shorter texts hold too few n-grams for that:
    they go only without letters, or if they are unlike all prototypes (cosine 0 or less).
    """
    text_batches(spark)
    profiles = langid.learn(docs)
    found = langid.predict(docs, profiles, keep=tuple(c for c in docs.columns if c != "doc_id"), prefix="__")
    short = F.length(F.regexp_replace("text", r"\P{L}", "")) < LETTERS
    score = F.col("__score")
    return found.where((F.col("__lang_pred") != langid.UNKNOWN) & ((score >= NOISES / profiles.dim**0.5) | ((score > 0) & short))).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share at least 80 % of their five-word shingles, the one with the smallest id.

    A row is known by a 64-bit hash of its id and text, so two texts of one id are two documents and a text without an id can
    be a copy too (it is kept only where no copy has an id).  Equal rows are copies: the one that is first by its other
    columns stays.  Texts without words have no copies but rows equal in id and text.
    """
    text_batches(spark)
    key = F.xxhash64("doc_id", "text")
    groups = stored(ngram_join.near_groups(docs.select(key.alias("doc_id"), "text"), width=5, percent=80, eighths=3, count_links=False).select(F.col("doc_id").alias("__key"), "component_id"), "groups")
    several = groups.groupBy("component_id").agg(F.count("*").alias("__n")).where("__n > 1").select("component_id")
    members = groups.join(several, "component_id").distinct()
    ids = docs.select(key.alias("__key"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("__id")).distinct()
    ranked = stored(members.join(ids, "__key"), "members")
    first = ranked.groupBy("component_id").agg(F.min(F.struct("__id", "__key"))["__key"].alias("__key")).select("__key")
    out = ranked.select("__key").distinct().join(first, "__key", "left_anti")
    once = without(docs, out.withColumnRenamed("__key", "doc_id"), key)
    repeated = stored(docs.groupBy(key.alias("doc_id")).agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return once
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    same = once.join(broadcast_up_to(repeated.withColumnRenamed("doc_id", "__key"), BROADCAST_IDS), key == F.col("__key"), "left_semi")
    kept = same.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("__0"), *rest)).alias("__row")).select("doc_id", "text", *(F.col("__row")[c].alias(c) for c in rest))
    return without(once, repeated, key).unionByName(kept.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.  A document without an id goes by the hash of its text.

    The ids found are written first: they are counted and joined, and the search runs once.
    """
    key = F.coalesce("doc_id", F.xxhash64("text"))
    held = decontaminate.contaminated(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, stored(held.select("doc_id").distinct(), "held"), key)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with merge-dropout, and whether they decode to the text.

    The ids are written before they are decoded: a task then needs one Python worker, not one for each of both steps.
    """
    text_batches(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = stored(sentencepiece_bpe.encode(own, model, keep=("text",)), "coded")
    decoded = sentencepiece_bpe.decode(coded, model, keep=("text", "ids"))
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("lossless"), F.col("ids").alias("token_ids"))


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

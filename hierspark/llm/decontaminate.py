"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Words are runs of letters and digits, lower-cased.  A mask selects some of the words of a window and ignores the
others; windows of a test item and of a document that agree on the selected words share a hash, so a substituted
word in an ignored place does not hide a copy.  Every hit fixes an alignment of item and document, and the words of the
whole item are compared there, place by place.

The masks are all choices of three words within five that begin with the first.  No alignment that meets the rule is
without a hit: if no five words in a row hold three that agree, blocks of five hold at most two each and what is left
over at most two, which is under 60 % of seven words or more; 13 of 16 leave three in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierspark.llm.util import broadcast_up_to

MASKS = ("111", "1101", "1011", "11001", "10101", "10011")
SHORTEST = min(map(len, MASKS))
LEAST_WORDS = 7
SHARE = 0.6
STRETCH, STRETCH_MATCHES = 16, 13
BROADCAST_WINDOWS = 1_000_000
BROADCAST_ITEMS = 100_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def window_hash(mask: str, listed: Column, at: Column) -> Column:
    """Hash of the selected words from a place on; the mask is part of it."""
    return F.xxhash64(F.lit(mask), *(F.get(listed, at + k) for k, used in enumerate(mask) if used == "1"))


def windows(df: DataFrame, fits_only: bool) -> DataFrame:
    """One row for each window and mask of the rows' ``_words``: ``_at`` and ``_hash``."""
    starts = F.when(F.size("_words") >= SHORTEST, F.sequence(F.lit(0), F.size("_words") - SHORTEST))
    placed = df.withColumn("_at", F.explode(starts))
    hashes = [window_hash(m, F.col("_words"), F.col("_at")) for m in MASKS]
    if fits_only:
        hashes = [F.when(F.col("_at") + len(m) <= F.size("_words"), h) for m, h in zip(MASKS, hashes)]
    return placed.withColumn("_hash", F.explode(F.array(*hashes)))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE) -> DataFrame:
    """Return one row for each document and item that it holds: (id, item, item_words, matches, start).

    A document holds an item if, at one alignment, ``share`` of the item's words agree, or 13 of 16 words in a
    row; ``matches`` is the largest number of agreeing words and ``start`` the first word of that alignment (negative if the
    item begins before the document).  Items of fewer than seven words say too little and are held by no document.  Every such
    alignment is found for a ``share`` of 60 % or more; below that, those with three of five words in a row that agree.
    NULL and empty texts hold nothing; repeated rows of one id give one row; empty tables give no rows; other columns are
    ignored.  The windows of the items are broadcast up to a counted million and joined by a shuffle beyond it.
    """
    tests = items.select(F.col(item_col).alias("_item"), words(F.col(item_text_col)).alias("_words")).where(F.size("_words") >= LEAST_WORDS)
    keys = windows(tests, fits_only=True).where(F.col("_hash").isNotNull()).select("_hash", "_item", F.col("_at").alias("_item_at"), F.size("_words").alias("_n")).distinct()
    listed = docs.select(F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_words"))
    hits = windows(listed, fits_only=False).join(broadcast_up_to(keys, BROADCAST_WINDOWS), "_hash")
    # a hit keeps the words of its alignment that the document has: a row of each hit with all words of a long text is size squared
    at, before = F.col("_at") - F.col("_item_at"), F.least(F.col("_at") - F.col("_item_at"), F.lit(0))
    placed = hits.select("_id", "_item", "_n", at.alias("_begin"), F.slice("_words", at - before + 1, F.col("_n") + before).alias("_region"))
    # judged where it is hit: only alignments that meet the rule are shuffled
    aligned = placed.join(broadcast_up_to(tests.select("_item", F.col("_words").alias("_item_words")).distinct(), BROADCAST_ITEMS), "_item")
    missing = -F.least("_begin", F.lit(0))
    agree = F.zip_with("_region", F.slice("_item_words", missing + 1, F.col("_n")), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    same = F.concat(F.array_repeat(F.lit(0), missing), agree)
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)
    pairs = aligned.where(F.size("_item_words") == F.col("_n")).select("_id", "_item", "_begin", "_n", same.alias("_same"))
    stretch = F.array_max(F.transform(F.sequence(F.lit(1), F.col("_n") - STRETCH + 1), lambda k: total(F.slice("_same", k, STRETCH))))
    best = F.when((F.col("_n") >= STRETCH) & (F.col("_matches") >= STRETCH_MATCHES), stretch)
    judged = pairs.withColumn("_matches", total(F.col("_same"))).withColumn("_best", F.coalesce(best, F.lit(0)))
    held = judged.where((F.col("_matches") >= share * F.col("_n")) | (F.col("_best") >= STRETCH_MATCHES))
    top = F.max(F.struct(F.col("_matches"), -F.col("_begin"), F.col("_n"))).alias("_top")
    return held.groupBy("_id", "_item").agg(top).select(
        F.col("_id").alias(id_col), F.col("_item").alias(item_col), F.col("_top._n").alias("item_words"), F.col("_top._matches").alias("matches"), (-F.col("_top.col2")).alias("start")
    )

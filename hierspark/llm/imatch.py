"""Document fingerprints by I-Match with randomised lexicons, with DataFrame functions only.

The terms of a text are its distinct lower-cased runs of letters and digits.  The lexicon keeps the terms whose inverse
document frequency lies in a band.  Random parts of the lexicon are drawn by hash: at scale s one term of 2^s, dealt
out to ``SLOTS`` subsets.  A fingerprint holds, for each subset, the hash of the sorted terms of the text in it.

A text's scale follows from its number of terms, so that a subset holds about one of them; the next scale is kept
too, since a changed text may be counted to the next one.  Likeness is the share of equal subset hashes among those
that are not empty in both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierspark.llm.util import next_ids, stored

SLOTS = 12
PER_SCALE = 12


@dataclass(frozen=True)
class Band:
    """Terms in at least ``least`` documents and at most ``share`` of all (but no fewer than ``floor``)."""

    least: int = 2
    share: float = 0.1
    floor: int = 20


def terms(text: Column) -> Column:
    """Hashes of the distinct terms."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def scale(n_terms: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n_terms, F.lit(1)) / PER_SCALE))).cast("int")


def kept_at(h: Column, at_scale: Column) -> Column:
    """Whether the low bits of a hash, as many as the scale, are zero."""
    return h.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), at_scale) - 1) == 0


def sampled(listed: Column, at_scale: Column) -> Column:
    """Hashes of the terms that the scale keeps."""
    hashes = F.transform(listed, lambda t: F.xxhash64(t))
    return F.filter(hashes, lambda h: kept_at(h, at_scale))


def slots(kept: Column, at_scale: Column) -> Column:
    """Subset hashes (32 bits) at the text's scale, then at the next one; NULL for an empty subset."""
    ordered = F.sort_array(kept)
    slot = lambda h: F.pmod(F.shiftrightunsigned(h, 40), F.lit(SLOTS))

    def subset(k: Column, s: Column) -> Column:
        own = F.filter(ordered, lambda h: kept_at(h, s) & (slot(h) == k))
        return F.when(F.size(own) > 0, F.shiftright(F.xxhash64(own), 32).cast("int"))

    numbers = F.array(*[F.lit(k) for k in range(SLOTS)])
    return F.concat(F.transform(numbers, lambda k: subset(k, at_scale)), F.transform(numbers, lambda k: subset(k, at_scale + 1)))


def as_text(at_scale: Column, hashes: Column) -> Column:
    return F.concat_ws(":", at_scale, F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lower(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit("-"))), ","))


def likeness(scale_a: Column, a: Column, scale_b: Column, b: Column) -> Column:
    """1 for equal fingerprints; else equal over non-empty subsets at the scales that both have; 0 without any."""
    first, second = (lambda x: F.slice(x, 1, SLOTS)), (lambda x: F.slice(x, SLOTS + 1, SLOTS))
    pairs = F.when(scale_a == scale_b, F.arrays_zip(a.alias("a"), b.alias("b"))).when(scale_b == scale_a + 1, F.arrays_zip(second(a).alias("a"), first(b).alias("b"))).when(scale_b == scale_a - 1, F.arrays_zip(first(a).alias("a"), second(b).alias("b")))
    either = F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull())
    equal = F.filter(either, lambda p: p["a"] == p["b"])
    return F.when((scale_a == scale_b) & a.eqNullSafe(b), F.lit(1.0)).when(F.size(either) > 0, F.size(equal) / F.size(either)).otherwise(F.lit(0.0))


def lexicon(docs: DataFrame, text_col: str, n_docs: int, band: Band) -> DataFrame:
    """Hashes of the terms in the band, counted over all documents."""
    rows = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("_term")).select(F.xxhash64("_term").alias("_h"))
    most = max(band.floor, int(band.share * n_docs))
    return rows.groupBy("_h").agg(F.count("*").alias("_df")).where(F.col("_df").between(band.least, most)).select("_h")


def edited(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _next, _text, _edited): the last quarter of a text replaced by as much of the next document's beginning.

    The next document has the next larger id; after the last comes the first.  A table of one document is its own next.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    needs = own.select("_id", F.floor(F.length("_text") / 4).cast("int").alias("_need")).join(next_ids(own.select("_id")), "_id")
    heads = needs.join(own.select(F.col("_id").alias("_next"), "_text"), "_next").select("_id", "_next", "_need", F.substring(F.col("_text"), F.lit(1), F.col("_need")).alias("_head"))
    kept = F.substring(F.col("_text"), F.lit(1), F.length("_text") - F.col("_need"))
    return own.join(heads, "_id").select("_id", "_next", "_text", F.concat(kept, "_head").alias("_edited"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: Band | None = None) -> DataFrame:
    """Return one row per id: fingerprints of the text and of its edited form, and their likeness.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  NULL texts are
    empty; an empty text has empty subsets and is like another empty text only.  Rows with a NULL id are left out.
    Repeated rows of an id give one row.  Other columns are ignored; an empty table gives no rows.
    """
    band = band or Band()
    counted = docs.where(F.col(id_col).isNotNull())
    known = lexicon(counted, text_col, counted.count(), band)
    pairs = edited(docs, id_col, text_col)
    sized = pairs.select("_id", "_next", F.length("_text").alias("_n"), F.unhex(F.sha2("_edited", 256)).alias("_sha"), terms(F.col("_text")).alias("_ta"), terms(F.col("_edited")).alias("_te"))
    scaled = sized.select("_id", "_next", "_n", "_sha", "_ta", "_te", scale(F.size("_ta")).alias("_sa"), scale(F.size("_te")).alias("_se"))
    drawn = scaled.select("_id", "_next", "_n", "_sha", "_sa", "_se", sampled(F.col("_ta"), F.col("_sa")).alias("_a"), sampled(F.col("_te"), F.col("_se")).alias("_e"))
    # One row more than terms: it carries what belongs to the document, under a key of its own that is in no lexicon.
    alone = F.xxhash64(F.lit("document"), "_id", "_sha")
    entry = F.explode(F.concat(F.array(F.lit(None).cast("bigint")), F.array_union("_a", "_e"))).alias("_term")
    rows = drawn.select("_id", "_next", "_n", "_sha", "_sa", "_se", "_a", "_e", entry)
    head = lambda c: F.when(F.col("_term").isNull(), F.col(c)).alias(c)
    in_a, in_e = F.array_contains("_a", F.col("_term")), F.array_contains("_e", F.col("_term"))
    side = F.when(in_a & in_e, 3).when(in_a, 1).when(in_e, 2).cast("byte").alias("_side")
    slim = rows.select("_id", *map(head, ("_next", "_n", "_sha", "_sa", "_se")), F.coalesce("_term", alone).alias("_h"), side)
    judged = slim.join(known.withColumn("_known", F.lit(True)), "_h", "left").where(F.col("_known") | F.col("_side").isNull())
    of = lambda k: F.collect_set(F.when(F.col("_side") == k, F.col("_h")))
    whole = judged.groupBy("_id").agg(*(F.max(c).alias(c) for c in ("_next", "_n", "_sha", "_sa", "_se")), of(1).alias("_a"), of(2).alias("_e"), of(3).alias("_both"))
    own, other = F.concat("_both", "_a"), F.concat("_both", "_e")
    # stored, since every fingerprint is read twice: as a document's own and as that of the next one
    prints = stored(whole.select("_id", "_next", "_n", "_sha", "_sa", "_se", slots(own, F.col("_sa")).alias("_fa"), slots(other, F.col("_se")).alias("_fe")), "fingerprints")
    after = prints.select(F.col("_id").alias("_next"), F.col("_sa").alias("_sn"), F.col("_fa").alias("_fn"))
    c = F.col
    return prints.join(after, "_next").select(
        c("_id").alias(id_col),
        c("_n").cast("bigint").alias("n_chars"),
        F.lower(F.hex("_sha")).alias("edited_sha256"),
        as_text(c("_sa"), c("_fa")).alias("fingerprint"),
        as_text(c("_se"), c("_fe")).alias("edited_fingerprint"),
        likeness(c("_sa"), c("_fa"), c("_se"), c("_fe")).alias("near_edited"),
        likeness(c("_sa"), c("_fa"), c("_sn"), c("_fn")).alias("near_next"),
    )

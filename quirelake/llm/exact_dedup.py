"""Exact dedup by progressive refinement, in Spark expressions only.

Texts are equal when they are the same after all blanks `[\\x20\\x09-\\x0D]` are deleted. Three levels, each over what
the one before left: length, then the hash of a prefix for texts whose length another text has, then the hash of the
whole text for those whose length and prefix another one has. Lengths and prefixes are counted per key; the keys met
twice or more set bits in a filter, sized from their number up to a bound, and each text meets the filter in the scan
itself, so that no text is ever shuffled. A bit set by chance costs one more hash and no result: the last level groups
by the full hash alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import BLANKS, bit_filter, own_columns, passing, settle, text_column

#: Code points of the normalised text that the second level hashes.
PREFIX = 256


def normalised(text: Column) -> Column:
    """The text without the characters `[\\x20\\x09-\\x0D]`."""
    return reduce(lambda t, blank: F.replace(t, F.lit(blank)), BLANKS, text)


def _head(raw: Column) -> Column:
    """The first PREFIX code points of the normalised text; the whole text is normalised only where its head is short."""
    head = normalised(F.left(raw, F.lit(2 * PREFIX)))
    return F.left(F.when(F.length(head) >= PREFIX, head).otherwise(normalised(raw)), F.lit(PREFIX))


def _sized(docs: DataFrame, *others: str) -> DataFrame:
    """(doc_id, raw, others, norm_len)."""
    rows = docs.select("doc_id", text_column(docs).alias("raw"), *others)
    return rows.withColumn("norm_len", F.length(normalised(F.col("raw"))))


def repeated_lengths(docs: DataFrame) -> DataFrame:
    """The filter of the lengths that several texts have."""
    return bit_filter(_sized(docs).groupBy("norm_len").agg(F.count("*").alias("n")).where("n > 1"), "norm_len")


def prefixes(docs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(norm_len, prefix_hash) of the texts whose length the filter lets through; no other is hashed."""
    some = passing(_sized(docs), lengths, "norm_len").where("_passes")
    return some.select("norm_len", F.xxhash64(_head(F.col("raw"))).alias("prefix_hash"))


def _filters(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The filters of the lengths, and of the (length, prefix) keys, met twice or more."""
    lengths = repeated_lengths(docs)
    keys = prefixes(docs, lengths).groupBy("norm_len", "prefix_hash").agg(F.count("*").alias("n")).where("n > 1")
    return lengths, bit_filter(keys, "norm_len", "prefix_hash")


def digests(docs: DataFrame, everywhere: bool = False, repeated: tuple[DataFrame, DataFrame] | None = None, others: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_code, text_sha256, survivor, others): survivor where another text has the same length and prefix, or may have.

    text_sha256 is given for survivors, and with everywhere for all rows. repeated: the filters, where they are there already.
    """
    lengths, keys = _filters(docs) if repeated is None else repeated
    sized = passing(_sized(docs, *others), lengths, "norm_len").withColumnRenamed("_passes", "_met")
    sized = sized.withColumn("prefix_hash", F.when(F.col("_met"), F.xxhash64(_head(F.col("raw")))))
    told = passing(sized, keys, "norm_len", "prefix_hash").withColumn("survivor", F.col("_met") & F.col("_passes"))
    full = F.sha2(normalised(F.col("raw")), 256)
    full = full if everywhere else F.when(F.col("survivor"), full)
    return told.select("doc_id", F.length("raw").alias("n_code"), full.alias("text_sha256"), "survivor", *others)


def _judged(some: DataFrame) -> DataFrame:
    """(doc_id, n_code, text_sha256, keep_id, group_size, kept) of the survivors (doc_id, n_code, text_sha256)."""
    best = F.min(F.struct(-F.col("n_code"), F.col("doc_id").isNull(), "doc_id"))
    groups = settle(some.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size")))
    groups = groups.select(
        "text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.col1")).alias("keep_len")
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_code") == F.col("keep_len"))
    return some.join(groups, "text_sha256").select("doc_id", "n_code", "text_sha256", "keep_id", "group_size", kept.alias("kept"))


def exact_dedup(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """One row a row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points of original text stays, then the smallest doc_id. A null text is empty; empty and all-blank texts are
    equal. Rows with the same doc_id and text are copies: all count in group_size, and kept marks each of them if
    their doc_id is keep_id and their length the longest. A null doc_id sorts last. Other columns of docs are not read. text_sha256 is null for
    texts without a possible copy unless digest_all.
    """
    rows = settle(digests(docs, digest_all))
    alone = rows.where("not survivor").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    some = rows.where("survivor").select("doc_id", "n_code", "text_sha256")
    shared = _judged(some).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return alone.unionByName(shared)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, one of each group, with the columns they came with.

    Rows are told apart by doc_id, length and the hash of the text together. Of kept rows that are alike in all three, one stays.
    """
    repeated = _filters(docs)
    some = settle(digests(docs, repeated=repeated).where("survivor").drop("survivor"))
    kinds = _judged(some).groupBy("doc_id", "n_code", "text_sha256", "kept").agg(F.count("*").alias("n"))
    told = settle(kinds.where("not kept or n > 1"))
    rows = digests(docs.withColumn("_row", F.struct(*own_columns(docs))), repeated=repeated, others=("_row",))
    mark = told.select(F.col("doc_id").alias("_id"), F.col("n_code").alias("_len"), F.col("text_sha256").alias("_sha"), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("n_code") == F.col("_len")) & (F.col("text_sha256") == F.col("_sha"))
    if told.where("kept").isEmpty():
        return rows.join(mark, same, "left_anti").select("_row.*")
    left = rows.join(mark, same, "left").where("kept is null or kept")
    once = left.where("kept").dropDuplicates(["doc_id", "n_code", "text_sha256"])
    return left.where("kept is null").unionByName(once).select("_row.*")

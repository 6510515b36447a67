"""Exact deduplication with a split for heavy hitters.

A Misra-Gries style frequent-items sketch (Spark's ``approx_top_k``) finds the digests that may hold a large
share of the rows. Their winners are counted exactly, broadcast (at most ``HEAVY`` rows) and applied where the
rows are, so no hot digest is ever shuffled. All other digests go through an ordinary shuffle, where a group is
below 1/HEAVY of the rows.

Defined results: null text counts as empty; texts are equal when identical without ``[\\x20\\x09-\\x0D]``; the
longest original (code points) stays, then the smallest doc_id (null last); of repeated rows (same doc_id and
text) exactly one stays; an empty table gives an empty result; further columns are carried by the stage
and ignored by the report, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, own, text_or_empty

HEAVY = 200  # most digests handled as heavy hitters; also the bound of the broadcast
TRACKED = 8192  # counters of the frequent-items sketch: its error is below rows * 3.5 / TRACKED


def _digest():
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(), r"[\x20\x09-\x0D]+", "").cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_cp, digest, row): one small row per document, written once."""
    return materialize(
        docs.select("doc_id", F.char_length(text_or_empty()).alias("n_cp"), _digest().alias("digest"))
        .withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )


def _rank():
    """Smallest first: the row that stays."""
    return F.struct(
        (-F.col("n_cp")).alias("longest"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row")
    )


def frequent(found: DataFrame) -> DataFrame:
    """At most HEAVY digests, all that a large share of the rows has among them."""
    top = found.select(F.expr(f"explode(approx_top_k(hex(digest), {HEAVY}, {TRACKED}))").alias("top"))
    return top.select(F.unhex("top.item").alias("digest"))


def heavy_winners(found: DataFrame) -> DataFrame:
    """At most HEAVY rows (digest, best, size): exact winners and sizes of the frequent digests."""
    return found.join(F.broadcast(frequent(found)), "digest").groupBy("digest").agg(F.min(_rank()).alias("best"), F.count("*").alias("size"))


def decisions(found: DataFrame, winners: DataFrame) -> DataFrame:
    """(doc_id, n_cp, digest, row, keep_id, group_size, kept) for every row of ``digests``."""
    marked = found.join(F.broadcast(winners), "digest", "left")
    hot = marked.where("size is not null")
    group = Window.partitionBy("digest")
    rest = (
        found.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("best", F.min(_rank()).over(group))
        .withColumn("size", F.count("*").over(group))
    )
    return hot.unionByName(rest).select(
        "doc_id", "n_cp", "digest", "row", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    found = digests(docs)
    return decisions(found, materialize(heavy_winners(found), "winners")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns.

    Copies of the heavy digests are removed by the broadcast winners before anything is shuffled. The others meet
    their decisions by doc_id, digest and length, which no group of copies shares; of rows that repeat all three one
    is taken, already where they are read.
    """
    found = digests(docs)
    winners = materialize(heavy_winners(found), "winners")
    keys = ["id", "no_id", "n_cp", "digest"]
    named = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id")]
    kept = decisions(found, winners).where("kept").select(*named, "n_cp", "digest")
    hot = winners.select("digest", F.coalesce("best.id", F.lit(0)).alias("best_id"), F.col("best.no_id").alias("best_no_id"), (-F.col("best.longest")).alias("best_n"))
    keyed = docs.select(own(docs), *named, F.char_length(text_or_empty()).alias("n_cp"), _digest().alias("digest"))
    left = keyed.join(F.broadcast(hot), "digest", "left").where("best_n is null or (best_id = id and best_no_id = no_id and best_n = n_cp)")
    one = left.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("best_n"))).where("place = 1")
    return one.join(kept.hint("merge"), keys, "left_semi").select("own.*")

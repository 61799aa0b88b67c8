"""Exact deduplication with a heavy-hitter split, in DataFrame and SQL functions only.

A frequent-items summary (the Misra-Gries family: ``approx_top_k`` keeps a fixed number of counters) names the digests
that may be frequent.  Their counts and winners are then computed exactly by one grouped aggregation, whose map side
leaves one row per digest and task, and broadcast: at most ``heavy`` rows of fixed width, whatever the input.  Rows with
such a digest are decided on the map side.  Every other digest is rarer than rows / ``heavy`` by the summary's guarantee,
so an ordinary shuffle by digest has no hot key.

Null texts count as empty.  Of rows with equal text the one with the largest id stays; a null id is smallest.  Rows that
repeat an id and its text are ordered by their position in the table, so exactly one row of each group stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import stored
from .textbytes import fresh_names

HEAVY = 1024


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, id, digest): one narrow row per document; ``row`` numbers the rows of the scan."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
                       F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)).alias("digest"))


def decisions(narrow: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(row, id, digest, keep_id, group_size, kept) for staged rows of :func:`digests`."""
    rank = F.struct("id", "row")
    named = narrow.agg(F.expr(f"approx_top_k(hex(digest), {heavy}, {16 * heavy})").alias("top"))
    named = named.select(F.explode("top").alias("t")).where("t.count > 1").select(F.unhex("t.item").alias("digest"))
    winners = (narrow.join(F.broadcast(named), "digest", "left_semi").groupBy("digest")
               .agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("size")))
    winners = stored(winners, "winners")  # both branches below must see the same split
    split = narrow.join(F.broadcast(winners), "digest", "left")
    group = Window.partitionBy("digest")
    rest = (split.where("size is null").withColumn("best", F.max(rank).over(group))
            .withColumn("size", F.count(F.lit(1)).over(group)))
    both = split.where("size is not null").unionByName(rest)
    return both.select("row", "id", "digest", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"),
                       (F.col("row") == F.col("best.row")).alias("kept"))


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", heavy: int = HEAVY) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (lowercase hex)."""
    d = decisions(stored(digests(docs, text, id_col), "digests"), heavy)
    return d.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    names, row = docs.columns, fresh_names(docs.columns, "_dedup_row")[0]
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    narrow = numbered.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("id"),
                             F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)).alias("digest"))
    lost = decisions(stored(narrow, "digests"), heavy).where(~F.col("kept")).select(F.col("row").alias(row))
    return numbered.join(lost, row, "left_anti").select(*[F.col(f"`{c}`") for c in names])

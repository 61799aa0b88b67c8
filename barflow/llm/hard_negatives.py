"""Hard-negative mining with cover trees over norm-augmented candidates.

Index: rows are dealt to the nearest of at most ``PIVOTS`` pivots (the top level, chosen farthest first from a sample of ``SAMPLE``
rows), and each pivot's rows by a hash of their row number into blocks of about ``BLOCK``; a block becomes one cover tree
(:mod:`cover_tree`) and one row of the staged index.  Every row is indexed; a vector that a third of the rows share is spread over
blocks like any other.

Search: anchors are taken in blocks of about ``ANCHORS``, whose vectors are broadcast (``ANCHORS`` x d numbers, whatever
the input).  Each task walks its trees best first with all anchors of the block, keeps the first candidates of each from tree to
tree, and emits them once; the tasks' candidates are merged by a window of anchors.  The first search gives the positives: the
first ``positives`` other rows of the same label.  Each positive's score bounds a window of scores; the second search skips
nodes outside of it and gives the first rows of other labels inside.  Scores of leaves are exact integers, so results are exact.

Rows with a null label, id or vector, or with null or non-finite entries, take no part, nor do vectors of another length than
the commonest one (of equally common ones the longest).  Quantised entries are held within 2 ** 28 in size (less above 64
dimensions), so scores fit 64 bits.  Rows that repeat an id are rows of their own: two anchors of one id give two sets of
rows, and an anchor's copy may be its positive.  Ties go to the smaller id.  Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import stored
from . import cover_tree
from .cover_tree import Best, Queries, unpacked
from .vectors import dimension, finite, matrix, quantised

PIVOTS = 64
SAMPLE = 2048
BLOCK = 1024
ANCHORS = 4096
_NO_LIMIT = 1 << 62


def _entry_bound(d: int) -> int:
    return min(1 << 28, int((2 ** 61 / d) ** 0.5))


def candidates(table: DataFrame, vector: str, label: Column, id_col: str, scale: float) -> tuple[DataFrame, int]:
    """Staged (row, id, label, q) of the rows that take part, and the number of dimensions."""
    rows = table.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(f"`{vector}`").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    d = dimension(rows, "v")
    rows = rows.where(F.size("v") == d) if d else rows.limit(0)
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", quantised(F.col("v"), scale, _entry_bound(d or 1)).alias("q")), "candidates"), d


def _pivots(rows: DataFrame) -> np.ndarray:
    """Farthest-first pivots from a bounded sample in hash order."""
    sample = np.array([r.q for r in rows.orderBy(F.xxhash64("row")).select("q").limit(SAMPLE).collect()], np.float64)
    chosen, reach = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < PIVOTS and reach.max() > 0:
        chosen.append(int(reach.argmax()))
        reach = np.minimum(reach, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def build_index(rows: DataFrame, d: int, block: int = BLOCK) -> DataFrame:
    """One row a block: the packed arrays of its cover tree."""
    pivots = rows.sparkSession.sparkContext.broadcast(_pivots(rows))

    def nearest(batches):
        p = pivots.value
        half = (p * p).sum(1) / 2
        for b in batches:
            cell = (matrix(b.column(3), d) @ p.T - half).argmax(1)
            yield pa.record_batch([*b.columns, pa.array(cell)], ["row", "id", "label", "q", "cell"])

    def tree(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")  # the same tree however rows arrive
        x = matrix(t.column("q").combine_chunks(), d).astype(np.float64)
        parts = cover_tree.build(x, *[np.asarray(t.column(c).combine_chunks()) for c in ("id", "row", "label")]).packed()
        return pa.table({name: pa.array([p], pa.binary()) for name, p in zip(cover_tree.FIELDS, parts)})
    celled = stored(rows.mapInArrow(nearest, "row bigint, id bigint, label bigint, q array<bigint>, cell bigint"), "celled")
    blocks = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = celled.join(blocks, "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("blocks")))
    dealt = dealt.repartition("cell", "part")  # a hot cell's blocks are dealt by block
    return stored(dealt.groupBy("cell", "part").applyInArrow(tree, ", ".join(f"{name} binary" for name in cover_tree.FIELDS)), "cover_trees")


def _first(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(query, place, score, id): the first ``k`` candidates of each query over the whole index."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        q = sent.value
        best = Best(len(q.x), k)
        for b in batches:
            for i in range(b.num_rows):
                cover_tree.search(unpacked([c[i].as_buffer() for c in b.columns]), q, best)
        at, place = np.nonzero(best.ids < np.iinfo(np.int64).max)
        yield pa.record_batch([pa.array(at), pa.array(best.scores[at, place]), pa.array(best.ids[at, place])], ["query", "score", "id"])
    found = index.select(*cover_tree.FIELDS).mapInArrow(run, "query bigint, score bigint, id bigint")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def mine(table: DataFrame, anchors: Column, vector: str = "embedding", label: Column | str = "label", id_col: str = "vec_id", scale: float = 256.0,
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``id``.  Negatives satisfy low * positive <= 100 * negative <= high * positive.
    """
    spark = table.sparkSession
    rows, d = candidates(table, vector, F.col(label) if isinstance(label, str) else label, id_col, scale)
    empty = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    total = rows.where(anchors).count() if d else 0
    if not total:
        return empty
    index, parts = build_index(rows, d), -(-total // ANCHORS)
    chosen = stored(rows.where(anchors).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))), "anchors")
    out = []
    for part in range(parts):
        block = chosen.where(F.col("part") == part).orderBy("row").toArrow()  # about ANCHORS rows
        if block.num_rows:
            out.append(_mine_block(index, block, d, positives, negatives, low, high))
    return reduce(DataFrame.unionByName, out)


def _mine_block(index: DataFrame, block: pa.Table, d: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = index.sparkSession
    x = matrix(block.column("q").combine_chunks(), d).astype(np.float64)
    rows, ids, labels = (np.asarray(block.column(c).combine_chunks()) for c in ("row", "id", "label"))
    wide = np.full(len(x), _NO_LIMIT, np.int64)
    near = stored(_first(index, Queries(x, rows, labels, -wide, wide, True), positives).select("query", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = near.select("query", "positive_score").distinct().orderBy("query", "positive_score").toArrow()  # ANCHORS x positives at most
    at, score = (np.asarray(scores.column(c).combine_chunks()) for c in ("query", "positive_score"))
    window = [(-(-low * s // 100), high * s // 100) for s in score.tolist()]
    bounds = np.array(window, np.int64).reshape(-1, 2)
    far = _first(index, Queries(x[at], rows[at], labels[at], bounds[:, 0], bounds[:, 1], False), negatives)
    names = spark.createDataFrame(pa.table({"query": np.arange(len(ids)), "anchor_id": ids}))
    windows = spark.createDataFrame(pa.table({"window": np.arange(len(at)), "query": at, "positive_score": score}))
    far = far.select(F.col("query").alias("window"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = near.join(windows, ["query", "positive_score"]).join(far, "window").join(names, "query")
    return stored(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives")

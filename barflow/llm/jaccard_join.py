"""N-gram Jaccard self-join with token-combination prefixes.

Texts become sets of hashed 5-word shingles (tokens).  Texts of equal sets form one class, kept once.  Two sets with
similarity of at least 0.75 must share 1 + e tokens among their first p + e tokens of any common order, where
p = n - ceil(0.75 n) + 1.

First index, over all classes, in hash order: each set posts its first p + e tokens, e = n / 25 + 2.  A token of at most
``RARE`` postings is indexed alone: its pairs are candidates.  A more frequent token is not indexed; a set that holds no
more frequent tokens than the extension makes up for shares a rare token with each partner, so it is settled here.

Second index, over the sets that hold more (members of large groups of near copies, texts made of common passages): tokens
are ordered by their frequency among these sets, rare first.  Tokens of at most ``RARE_AGAIN`` postings are again indexed
alone.  In a more frequent bucket each set is compared with a few hubs of the bucket only, in ``TURNS`` turns; buckets whose
sets then are one component are settled.  Open buckets of more than ``CROWD`` sets get their prefixes extended by one token and
are split by combinations of k tokens, k growing by one a level, up to ``LEVELS``; of smaller ones, sets of different
components are compared in blocks by matrix products.

Candidates must pass size and count bounds; then whole token sets are compared.  No list of a bucket is ever gathered: a
pass over sorted postings holds at most ``RARE`` of them.

A text with fewer than five words has its whole word sequence as one token; null, empty and blank texts have no token and
are linked with nothing.  Tokens are 64-bit hashes, classes 64-bit sums of rehashed tokens.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import stored
from .components import components
from .textbytes import fresh_names, hash_runs, mix, odd_constants, row_of, runs, slices
from .textstats import LOWERED

WORDS = 5
RARE = 16
RARE_AGAIN = 64
LEVELS = 3
TURNS = 1
HUBS = 4
BLOCK = 256
COLUMNS = 1 << 13
CROWD = 1 << 14
FILTER_BITS = 23
_STEP = odd_constants(WORDS + 3, 307)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def token_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens in order within each row, first token of each row, class of each row)."""
    n = len(offsets) - 1
    low = LOWERED[data]
    starts, ends = runs(~_BLANK[low], offsets)
    h, row = hash_runs(low, starts, ends), row_of(starts, offsets)
    words = np.bincount(row, minlength=n)
    with np.errstate(over="ignore"):
        tokens, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(h) >= WORDS:
            m = len(h) - WORDS + 1
            tokens = sum(h[k:k + m] * _STEP[k] for k in range(WORDS))
            inside = row[WORDS - 1:] == row[:m]
            tokens, owner = tokens[inside], row[:m][inside]
        few = np.flatnonzero((words > 0) & (words < WORDS))
        if len(few):
            at = np.append(0, np.cumsum(words))[few]
            short = words[few].astype(np.uint64) * _STEP[WORDS]
            for k in range(WORDS - 1):
                on = words[few] > k
                short[on] += h[at[on] + k] * _STEP[k]
            tokens, owner = np.concatenate((tokens, short)), np.concatenate((owner, few))
        tokens = mix(tokens)
        order = np.argsort(tokens)
        order = order[np.argsort(owner[order].astype(np.uint16) if n < 1 << 16 else owner[order], kind="stable")]
        tokens, owner = tokens[order], owner[order]
        new = np.append(True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1]))[:len(tokens)]
        tokens, owner = tokens[new], owner[new]
        first = np.searchsorted(owner, np.arange(n + 1))
        total = np.append(np.uint64(0), np.cumsum(mix(tokens ^ _STEP[WORDS + 1])))
        size = np.diff(first)
        kind = mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64) * _STEP[WORDS + 2])
    return tokens, first, kind


def _prefix(n):
    return n - (3 * n + 3) // 4 + 1


def _extension(n):
    return n // 25 + 2


def _prefixes(docs: DataFrame) -> DataFrame:
    """(id, n, set, tokens): size, class and first p + e tokens of every row."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(1)):
                tokens, first, sets = token_sets(data, offsets)
                n = np.diff(first)
                take = np.minimum(n, _prefix(n) + _extension(n))
                held = np.append(0, np.cumsum(take))
                pick = np.arange(held[-1]) + np.repeat(first[:-1] - held[:-1], take)
                lists = pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), pa.array(tokens[pick].view(np.int64)))
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(sets.view(np.int64)), lists], ["id", "n", "set", "tokens"])
    return docs.mapInArrow(run, f"id {kind}, n bigint, set bigint, tokens array<bigint>")


def _ceil_div(a, b: int) -> Column:
    return F.floor((a + (b - 1)) / b)


def _whole_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(set, n, tokens) of the classes in ``needed`` (set, id): all tokens, from a second pass over the texts.

    A bit table of fixed size over the ids of one member each lets most other texts pass unread; a join by class makes it
    exact.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    rows = (needed.select((F.floor(bit / 32768)).cast("int").alias("page"), (bit % 32768).alias("bit")).groupBy("page")
            .agg(F.bitmap_construct_agg("bit").alias("bits")).collect())  # 2 ** FILTER_BITS bits at most
    table = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in rows:
        table[r.page * 4096:(r.page + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)[:4096]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for b in batches:
            at = np.asarray(b.column(0))
            on = shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1
            texts = b.column(1).filter(pa.array(on.astype(bool)))
            for lo, hi, data, offsets in slices(texts):
                tokens, first, sets = token_sets(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens.view(np.int64)))
                one = np.unique(sets, return_index=True)[1]
                yield pa.record_batch([pa.array(sets.view(np.int64)), pa.array(np.diff(first)), lists], ["set", "n", "tokens"]).take(pa.array(one))
    found = docs.select(bit.alias("bit"), "text").mapInArrow(run, "set bigint, n bigint, tokens array<bigint>")
    return found.join(needed.select("set"), "set", "left_semi").dropDuplicates(["set"])


def _pairs_of_rare(postings: DataFrame, rare: int) -> DataFrame:
    """From postings (token, set, n), dealt and sorted by token: candidate pairs with the number of tokens they share, and
    frequent tokens' postings.

    Rows: a, b, na, nb, c for a pair that can be similar by size; a, null, na, null, c for ``c`` frequent tokens of set a.
    """
    def run(batches):
        left = None

        def emit(t, s, n, closed):
            """Rows of the closed groups, and the rows of the last group unless all are closed."""
            start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            size = np.diff(np.append(start, len(t)))
            keep = None
            if not closed and len(start):
                if size[-1] <= rare:
                    keep = (t[start[-1]:], s[start[-1]:], n[start[-1]:])
                    start, size = start[:-1], size[:-1]
                else:  # frequent already: its rows go out, a stub of it goes on
                    stub = slice(start[-1], start[-1] + rare + 1)
                    keep = (t[stub], np.full(rare + 1, 0), np.full(rare + 1, -1))
            group = np.repeat(np.arange(len(start)), size)
            pos = np.arange(len(group)) - np.repeat(start, size)
            a, b = [], []
            big = size > rare
            often = s[:len(group)][big[group] & (n[:len(group)] >= 0)]
            often_n = n[:len(group)][big[group] & (n[:len(group)] >= 0)]
            small = ~big[group]
            for k in range(1, rare):
                x = np.flatnonzero(small & (pos + k < size[group]))
                if not len(x):
                    break
                fit = 4 * np.minimum(n[x], n[x + k]) >= 3 * np.maximum(n[x], n[x + k])
                x = x[fit]
                first = s[x] < s[x + k]
                a.append(np.where(first, x, x + k))
                b.append(np.where(first, x + k, x))
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            out = []
            if len(a):
                order = np.lexsort((s[b], s[a]))
                a, b = a[order], b[order]
                at = np.flatnonzero(np.append(True, (s[a][1:] != s[a][:-1]) | (s[b][1:] != s[b][:-1])))
                a, b, c = a[at], b[at], np.diff(np.append(at, len(a)))
                out.append([pa.array(s[a]), pa.array(s[b]), pa.array(n[a]), pa.array(n[b]), pa.array(c)])
            if len(often):
                u, at, c = np.unique(often, return_index=True, return_counts=True)
                none = pa.nulls(len(u), pa.int64())
                out.append([pa.array(u), none, pa.array(often_n[at]), none, pa.array(c)])
            return [pa.record_batch(x, ["a", "b", "na", "nb", "c"]) for x in out], keep

        for batch in batches:
            if not batch.num_rows:
                continue
            t, s, n = (np.asarray(batch.column(i)) for i in range(3))
            if left is not None:
                t, s, n = (np.concatenate(x) for x in zip(left, (t, s, n)))
            out, left = emit(t, s, n, False)
            yield from out
        if left is not None:
            yield from emit(*left, True)[0]
    return postings.repartition("token").sortWithinPartitions("token", "set").mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint, c bigint")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole token sets are similar enough."""
    one = sets.select(F.col("set").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("set").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    d = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", common.alias("i"), (F.size("ta") + F.size("tb")).alias("s"))
    return d.where("100 * i >= 75 * (s - i)").select("a", "b")


def _first_index(classes: DataFrame, rare: int) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs a, b; sets that need the second index)."""
    found = stored(_pairs_of_rare(classes.select(F.explode("tokens").alias("token"), "set", "n"), rare), "rare_postings")
    pairs = found.where("b is not null").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("c").alias("c"))

    def unseen(n: str) -> Column:
        c = F.col(n)
        return F.greatest(c - (c - _ceil_div(3 * c, 4) + 1) - F.floor(c / 25) - 2, F.lit(0))
    need = _ceil_div(3 * (F.col("na") + F.col("nb")), 7)
    spare = F.floor(F.greatest("na", "nb") / 25) + 2
    pairs = pairs.where(F.col("c") + spare + F.greatest(unseen("na"), unseen("nb")) >= need)
    often = found.where("b is null").groupBy(F.col("a").alias("set")).agg(F.first("na").alias("n"), F.sum("c").alias("m"))
    # frequent tokens may be as many as the shortest possible partner's extension
    dense = often.where(F.col("m") > F.floor(_ceil_div(3 * F.col("n"), 4) / 25) + 2)
    return pairs.select("a", "b"), dense.select("set")


def _ordered_prefixes(sets: DataFrame) -> DataFrame:
    """(set, n, p, skip, own): tokens that other sets share as (df, token), rare first, p + LEVELS at most.

    ``skip`` tokens that no other set has come before them and take their places in the prefix.
    """
    t = sets.select("set", "n", F.explode("tokens").alias("token"))
    count = t.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    shared = t.join(count.where("df > 1"), "token")
    g = shared.groupBy("set").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))  # one set's tokens
    p = (F.col("n") - _ceil_div(3 * F.col("n"), 4) + 1)
    g = g.withColumn("skip", F.col("n") - F.size("own")).withColumn("p", (p - F.col("skip")).cast("int"))
    return g.where("p > 0").select("set", "n", "p", "skip", F.slice("own", 1, F.col("p") + LEVELS).alias("own"))


def _sized_postings(own: DataFrame) -> DataFrame:
    """(token, set, n, at): postings in buckets of a token and two neighbouring size classes, without dead ones.

    If the first token that x and y share has place i in x, they share at most n - i tokens, so a link needs a partner of
    at most floor(7 (n - i) / 3) - n tokens; a posting is dead where its bucket's smallest set is larger.
    """
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(4 / 3)) + 1e-9)
    d = own.select("set", "n", "skip", F.posexplode(F.slice("own", 1, F.col("p"))).alias("at", "t"))
    d = d.select("set", "n", "at", F.col("t.token").alias("token"), (F.floor(7 * (F.col("n") - F.col("skip") - F.col("at")) / 3) - F.col("n")).alias("most"),
                 F.explode(F.array(step, step - 1)).alias("step"))
    d = d.withColumn("token", F.xxhash64("token", "step")).drop("step")
    least = stored(d.groupBy("token").agg(F.min("n").alias("least")), "least")  # a table of its own, so a hot bucket can be split
    return d.join(least, "token").where("least <= most").select("token", "set", "n", "at")


def _open(often: DataFrame, links: DataFrame) -> DataFrame:
    """Postings of the buckets whose sets are not one component yet, with the sets' components."""
    roots = components(links).select(F.col("key").alias("set"), "root")
    d = often.drop("root").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    mixed = d.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return stored(d.join(mixed, "token"), "open")


def _star(postings: DataFrame, turn: int) -> DataFrame:
    """Each set with a few sets of its bucket: the smallest one, and the least by ``HUBS`` hashes of this turn."""
    orders = [F.struct("n", "set")] + [F.struct(F.xxhash64("set", F.lit(turn * HUBS + i)).alias("h"), "n", "set") for i in range(HUBS)]
    hubs = postings.groupBy("token").agg(*[F.min(o).alias(f"hub{i}") for i, o in enumerate(orders)])
    hubs = hubs.select("token", F.explode(F.array_distinct(F.array(*[F.struct(f"hub{i}.n", f"hub{i}.set") for i in range(len(orders))]))).alias("hub"))
    d = postings.join(stored(hubs, "hubs"), "token")  # a table of its own, so a hot bucket can be split or met by broadcast
    d = d.where("set <> hub.set and 4 * least(n, hub.n) >= 3 * greatest(n, hub.n)")
    return d.select(F.least("set", "hub.set").alias("a"), F.greatest("set", "hub.set").alias("b")).distinct()


def _second_index(sets: DataFrame, known: DataFrame, rare: int, turns: int, crowd: int) -> DataFrame:
    """Links found among ``sets`` (set, n, tokens), given the links known."""
    own = stored(_ordered_prefixes(sets), "ordered_prefixes")
    links, left = known, None
    level = _sized_postings(own)
    for k in range(1, LEVELS + 1):
        level = stored(level, "combinations")
        size = stored(level.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket_sizes")
        few = _pairs_of_rare(level.join(size.where(f"size between 2 and {rare}"), "token").select("token", "set", "n"), rare)
        few = few.where("b is not null").select("a", "b").distinct()
        links = stored(links.unionByName(_verified(few, sets)).distinct(), "links")
        now = stored(level.join(size.where(f"size > {rare}").select("token"), "token").withColumn("root", F.col("set")), "frequent")
        for turn in range(turns):
            if not now.take(1):
                break
            links = stored(links.unionByName(_verified(_star(now, turn), sets)).distinct(), "links")
            now = _open(now, links)
        crowded = now.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > (crowd if k < LEVELS else 1 << 62)).select("token")
        rest = now.join(crowded, "token", "left_anti")
        left = rest if left is None else left.unionByName(rest)
        more = now.join(crowded, "token").select("token", "set", "n", "at").join(own.select("set", "p", "own"), "set")
        more = more.select("token", "set", "n", "at", F.posexplode(F.slice("own", 1, F.col("p") + k)).alias("next", "t")).where("next > at")
        level = more.select("set", "n", F.col("next").alias("at"), F.xxhash64("token", "t.token").alias("token"))
        if not crowded.take(1):
            break
    return links.unionByName(_links_across(left, sets)).distinct()


def _similar_in_blocks(t: pa.Table) -> pa.Table:
    """Links between sets of two blocks (or within one) that are of different components, from matrix products."""
    lists = t.column("tokens").combine_chunks()
    size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    _, column, count = np.unique(np.asarray(lists.flatten()), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(size)), size)
    shared = count[column] > 1
    place = np.cumsum(count > 1) - 1
    row, column = row[shared], place[column[shared]]
    block = np.asarray(t.column("block").combine_chunks())
    left, right = np.flatnonzero(block == t.column("i")[0].as_py()), np.flatnonzero(block == t.column("j")[0].as_py())
    common = np.zeros((len(left), len(right)))
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        on = (column >= lo) & (column < lo + COLUMNS)
        x = np.zeros((len(size), COLUMNS), np.float32)
        x[row[on], column[on] - lo] = 1
        common += x[left] @ x[right].T
    root, key = np.asarray(t.column("root").combine_chunks()), np.asarray(t.column("set").combine_chunks())
    fit = (100 * common >= 75 * (size[left][:, None] + size[right] - common)) & (root[left][:, None] != root[right])
    x, y = np.nonzero(fit)
    return pa.table({"a": np.minimum(key[left[x]], key[right[y]]), "b": np.maximum(key[left[x]], key[right[y]])})


def _links_across(now: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between sets that are in one chain of open buckets but in different components.

    The sets of a chain are dealt into blocks of about ``BLOCK``; each two blocks are compared by one group.
    """
    hub = now.groupBy("token").agg(F.min("set").alias("b"))
    area = components(now.select("token", F.col("set").alias("a")).join(hub, "token").select("a", "b").distinct())
    d = now.select("set", "root").distinct().join(area.select(F.col("key").alias("set"), F.col("root").alias("area")), "set")
    d = stored(d.join(sets.select("set", "tokens"), "set"), "areas")
    parts = d.groupBy("area").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    d = d.join(parts, "area").withColumn("block", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    d = d.select("area", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "root", "tokens")
    return d.repartition("area", "i", "j").groupBy("area", "i", "j").applyInArrow(_similar_in_blocks, "a bigint, b bigint")


def similar_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rare: int = RARE, rare_again: int = RARE_AGAIN,
                   turns: int = TURNS, crowd: int = CROWD) -> DataFrame:
    """(id, n_shingles, component_id) of every row; the component id is the smallest id reachable by links.

    The last four arguments steer the work only, not the result.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = stored(_prefixes(d), "prefixes")
    classes = rows.where("n > 0").groupBy("set").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    first, dense = _first_index(classes, rare)
    first, dense = stored(first, "candidates"), stored(dense, "dense")
    wanted = first.select(F.col("a").alias("set")).unionByName(first.select(F.col("b").alias("set"))).unionByName(dense).distinct()
    least = stored(rows.where("n > 0").groupBy("set").agg(F.min("id").alias("id")), "classes")
    sets = stored(_whole_sets(d, stored(least.join(wanted, "set", "left_semi"), "wanted")), "sets")
    links = stored(_verified(first, sets), "links")
    links = _second_index(stored(sets.join(dense, "set", "left_semi"), "dense_sets"), links, rare_again, turns, crowd)
    roots = stored(components(links), "roots")
    named = roots.join(least.withColumnRenamed("set", "key"), "key")
    lowest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = stored(least.join(named.join(lowest, "root").select(F.col("key").alias("set"), "component_id"), "set", "left")
                    .select("set", F.coalesce("component_id", "id").alias("component_id")), "labels")
    linked = rows.where("n > 0").select("id", "n", "set").join(labels, "set").select("id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is their component's, with all their columns."""
    groups, name = similar_groups(docs, text, id_col), fresh_names(docs.columns, "_lost")[0]
    lost = groups.where(~F.col(f"`{id_col}`").eqNullSafe(F.col("component_id"))).select(F.col(f"`{id_col}`").alias(name)).distinct()
    return docs.join(lost, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_anti")

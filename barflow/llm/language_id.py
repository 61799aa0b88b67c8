"""Language identification of web pages by Bayesian evidence fusion.

For every page four kinds of evidence meet in one posterior over the languages of the training texts:

* text: a naive Bayes likelihood of hashed byte trigrams of the visible text, tempered to ``GRAMS`` independent trigrams;
* declared: the primary subtag of ``<html lang>``, wherever the tag stands outside comments, scripts and styles;
* address: a language code that is the path's first segment, else the last label of the host name;
* host: a prior smoothed from the whole table through the address's last label and its last two labels to the host (so
  hosts under a two-label suffix like co.uk share that level, and a numeric address's last number counts as a label).

How far declared and address values are to be trusted is counted over all pages: the share of each value among pages
whose text is clear (text posterior of ``CLEAR`` or more), with add-one smoothing over all values; the table of every
value is joined by value.  Values of no clear page say nothing.  Priors are counted over the same pages by grouped
aggregation; each level is smoothed towards the one above with the weight of ``PRIOR`` pages.

The trigram model is trained on ``SAMPLE`` documents with a language (chosen by a hash of the id) and up to ``EACH`` more
of each language, so that rare ones are learnt too.  It has ``BUCKETS`` numbers a language and is what is broadcast.
Every language enters that has a document with an id and a trigram.

Null, empty and malformed addresses have the host "" and no address value; null markup has no text and no declared value.
Without training texts the language is null with posterior null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import stored
from .textbytes import slices
from .textstats import LOWERED

SAMPLE, EACH = 4_000, 64
BUCKETS_LOG = 15
BUCKETS = 1 << BUCKETS_LOG
GRAMS = 60.0
CLEAR = 0.9
PRIOR = 5.0
_MUL = np.uint32(2654435761)


def _element(names: str) -> str:
    """Pattern of an element with all it holds."""
    return rf"<({names})\b[^>]*+(?:\z|>.*?(?:</\1\s*+>|\z))"


def visible_text(html: Column) -> Column:
    """Text of markup: without comments, scripts, styles, navigation and tags; the common entities are resolved.

    What is not closed ends with the markup, so each pattern passes a text once, whatever it holds.
    """
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--(?:-?>|.*?(?:-->|\z))|" + _element("script|style|nav") + r"|<[a-z/!?][^>]*+(?:>|\z)", " ")
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def declared_language(html: Column) -> Column:
    """Primary subtag of the first ``<html>`` tag with a language, in lower case, or ""; comments, scripts and styles do not count."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--(?:-?>|.*?(?:-->|\z))|" + _element("script|style"), " ")
    return F.lower(F.regexp_extract(t, r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1))


def evidence(pages: DataFrame, url: str = "url", html: str = "html", id_col: str = "page_id") -> DataFrame:
    """(id, text, host, domain, suffix, declared, path_code) of every page."""
    u, h = F.coalesce(F.col(f"`{url}`"), F.lit("")), F.col(f"`{html}`")
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    declared = declared_language(h)
    code = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    d = pages.select(F.col(f"`{id_col}`").alias("id"), visible_text(h).alias("text"), host.alias("host"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(code, F.lit("")).alias("path_code"))
    return d.withColumns({"suffix": F.regexp_extract("host", r"([^.]*)$", 1), "domain": F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)})


def _buckets(data: np.ndarray) -> np.ndarray:
    b = LOWERED[data].astype(np.uint32)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * _MUL >> np.uint32(32 - BUCKETS_LOG)).astype(np.int64)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", bound: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log probability of each bucket in each."""
    known = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{id_col}`")).alias("h"))
    first = stored(known.where("octet_length(text) > 2").groupBy("lang", F.pmod("h", F.lit(EACH)).alias("class")).agg(F.min("h").alias("h")), "language_samples")
    names = sorted(r.lang for r in first.select("lang").distinct().collect())  # one row a language
    place = {x: i for i, x in enumerate(names)}
    chosen = known.select("h", "id").orderBy("h", "id").limit(bound).select("h").union(first.select("h"))
    rows = known.join(F.broadcast(chosen), "h", "left_semi")

    def run(batches):
        for b in batches:
            own = b.column(0).to_pylist()
            for lo, hi, data, offsets in slices(b.column(1)):
                if len(data) < 3:
                    continue
                code = np.array([place.get(x, -1) for x in own[lo:hi]])
                gram = _buckets(data)
                row = np.searchsorted(offsets, np.arange(len(gram)), side="right") - 1
                fit = (np.arange(len(gram)) + 3 <= offsets[row + 1]) & (code[row] >= 0)
                cell, n = np.unique(code[row[fit]] * BUCKETS + gram[fit], return_counts=True)
                yield pa.record_batch([pa.array(cell), pa.array(n)], ["cell", "n"])
    counts = np.zeros((len(names), BUCKETS))
    cells = rows.select("lang", "text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS a language
    counts.reshape(-1)[np.asarray(cells.column("cell"))] = np.asarray(cells.column("n"))
    counts += 0.5
    counts /= counts.sum(axis=1, keepdims=True)
    return names, np.log(counts, out=counts)


def text_likelihoods(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``rows`` with ``ll`` (one log likelihood a language, tempered) in place of ``text``."""
    where = rows.columns.index("text")
    shared = rows.sparkSession.sparkContext.broadcast(model[1].astype(np.float32))
    keep = [c for c in rows.columns if c != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"] + ["ll array<double>"])

    def run(batches):
        table = shared.value
        k = len(table)
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(where)):
                ll, grams = np.zeros((hi - lo, k)), np.maximum(np.diff(offsets) - 2, 0)
                if len(data) > 2:
                    gram = _buckets(data)
                    start, stop = np.minimum(offsets[:-1], len(gram)), np.minimum(offsets[:-1] + grams, len(gram))
                    for j in range(k):
                        total = np.append(0, np.cumsum(table[j][gram], dtype=np.float64))
                        ll[:, j] = total[stop] - total[start]
                ll *= (np.minimum(grams, GRAMS) / np.maximum(grams, 1))[:, None]
                first = np.arange(0, ll.size + 1, max(k, 1), dtype=np.int32) if k else np.zeros(hi - lo + 1, np.int32)
                cols = [b.column(i).slice(lo, hi - lo) for i in range(b.num_columns) if i != where]
                yield pa.record_batch([*cols, pa.ListArray.from_arrays(pa.array(first), pa.array(ll.ravel()))], [*keep, "ll"])
    return rows.mapInArrow(run, schema)


def _let(x: Column, of: Callable[[Column], Column]) -> Column:
    """``of(x)`` with ``x`` computed once, also where lambdas read it many times."""
    return F.transform(F.array(x), of)[0]


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _normal(x: Column) -> Column:
    """Probabilities of an array of logarithms."""
    powers = _let(x, lambda y: _let(F.array_max(y), lambda top: F.transform(y, lambda v: F.exp(v - top))))
    return _let(powers, lambda e: _let(_total(e), lambda total: F.transform(e, lambda v: v / total)))


def _counts(clear: DataFrame, keys: list[str], k: int, into: str) -> DataFrame:
    """(keys, array of counts by language); one row a key, summed by key and language first."""
    sums = clear.groupBy(*keys, "best").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    held = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "_n"))).alias("_m"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias(into))


def _smoothed(counts: Column, above: Column) -> Column:
    return _let(_total(counts), lambda total: F.zip_with(counts, above, lambda n, p: (n + PRIOR * p) / (total + PRIOR)))


def identify(pages: DataFrame, docs: DataFrame, url: str = "url", html: str = "html", id_col: str = "page_id") -> DataFrame:
    """(id, lang, posterior, text_lang, declared, address, host) of every page."""
    names, table = train(docs)
    k = len(names)
    if not k:
        e = evidence(pages, url, html, id_col)
        return e.select(F.col("id").alias(id_col), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"),
                        F.lit(None).cast("string").alias("text_lang"), "declared", F.coalesce("path_code", "suffix").alias("address"), "host")
    codes = F.array(*[F.lit(n) for n in names])
    d = text_likelihoods(evidence(pages, url, html, id_col), (names, table))
    d = d.withColumn("address", F.when(F.array_contains(codes, F.col("path_code")), F.col("path_code")).otherwise(F.nullif("suffix", F.lit(""))))
    d = d.withColumn("p", _normal(F.col("ll")))
    d = stored(d.withColumn("best", F.array_position("p", F.array_max("p")).cast("int") - 1).withColumn("clear", F.array_max("p") >= CLEAR), "page_evidence")
    clear = d.where("clear")

    seen = np.ones(k)
    for r in clear.groupBy("best").count().collect():  # one row a language
        seen[r.best] += r["count"]
    prior = F.array(*[F.lit(float(v)) for v in seen / seen.sum()])
    suffixes = _counts(clear, ["suffix"], k, "n").select("suffix", _smoothed(F.col("n"), prior).alias("above"))
    domains = _counts(clear, ["suffix", "domain"], k, "n").join(suffixes, "suffix").select("domain", _smoothed(F.col("n"), F.col("above")).alias("above"))
    hosts = _counts(clear, ["domain", "host"], k, "n").join(domains, "domain").select("host", _smoothed(F.col("n"), F.col("above")).alias("host_prior"))
    hosts = stored(hosts, "host_priors")

    def trust(column: str) -> DataFrame:
        """(column, log likelihoods of the value, given the language) of every value of a column."""
        told = clear.where(F.col(column).isNotNull())
        values = stored(_counts(told, [column], k, "n"), f"{column}_trust")
        total = np.full(k, float(values.count()))
        for r in told.groupBy("best").count().collect():  # one row a language
            total[r.best] += r["count"]
        totals = F.array(*[F.lit(float(v)) for v in total])
        return values.select(column, F.zip_with("n", totals, lambda n, t: F.ln((n + 1.0) / t)).alias(f"by_{column}"))

    zero = F.array(*[F.lit(0.0)] * k)
    by_declared, by_address = F.coalesce("by_declared", zero), F.coalesce("by_address", zero)
    host_prior = F.transform(F.coalesce("host_prior", prior), lambda p: F.ln(p))
    joint = F.zip_with(F.zip_with("ll", by_declared, lambda a, b: a + b), F.zip_with(by_address, host_prior, lambda a, b: a + b), lambda a, b: a + b)
    out = d.join(hosts, "host", "left").join(trust("declared"), "declared", "left").join(trust("address"), "address", "left").withColumn("post", _normal(joint))
    at = F.array_position("post", F.array_max("post")).cast("int")
    return out.select(F.col("id").alias(id_col), F.element_at(codes, at).alias("lang"), F.array_max("post").alias("posterior"),
                      F.element_at(codes, F.col("best") + 1).alias("text_lang"), "declared", "address", "host")

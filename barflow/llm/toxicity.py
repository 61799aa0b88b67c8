"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon, second-person words and lexicon words near them, capitals, punctuation, shouts
and obfuscated words.  The lexicon holds hashed words and word beginnings that are far commoner in toxic training texts; it
is learnt on the training rows by folds, and a row's features for training use the lexicon of the other folds, so the
trees see the lexicon as it behaves on new texts.  Spark ML grows the trees; an isotonic regression on training rows that
the trees have not seen turns their probability into a calibrated score.

Training uses at most ``SAMPLE`` labelled rows (see ``labelled``); held-out documents, lang, source and ids give no input.
Null and empty texts have zero counts.  Without rows of both classes every score is the share of label 1 (0 without rows).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import stored
from .labelled import SAMPLE, held_out, training_rows
from .textbytes import BYTE_VALUE, hash_runs, mix, odd_constants, runs, slices
from .textstats import DIGIT, LOWER, LOWERED, PUNCT, SHOUT, SYMBOL, UPPER, _KIND, byte_counts

THRESHOLD = 0.7
FOLDS = 4
STEMS = range(3, 10)  # bytes of a word's beginning
TABLE_BITS = 22
TOXIC, ODDS = 3, 2.5
LEXICON = 1 << 12
NEAR = 5
FEATURES = ("words", "listed", "listed_share", "strongest", "weight_share", "kinds", "second_person", "listed_near_second_person",
            "upper", "punctuation", "shouts", "symbols", "obfuscated", "digits")
#: Second-person words of the languages at hand.
SECOND_PERSON = ("you", "your", "yours", "yourself", "ya", "u", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos",
                 "du", "dich", "dir", "dein", "deine", "euch", "ihr", "tus", "ti", "usted", "ustedes", "vosotros")
_STEP = odd_constants(max(STEMS) + 1, 211)
_LETTER = np.isin(_KIND, (LOWER, UPPER)) | (np.arange(256) >= 0x80)


def _letter_words(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = runs(_LETTER[low], offsets)
    return starts, ends, hash_runs(low, starts, ends)


def _second_person() -> np.ndarray:
    texts = [w.encode() for w in SECOND_PERSON]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    return np.sort(hash_runs(data, ends - [len(t) for t in texts], ends))


def stems(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, stem hashes) for whole words and for each length of beginning."""
    pad = np.concatenate((low, np.zeros(max(STEMS), np.uint8)))
    size, total = ends - starts, np.zeros(len(starts), np.uint64)
    out = [(np.arange(len(starts)), whole)]
    with np.errstate(over="ignore"):
        for k in range(max(STEMS)):
            total = total + BYTE_VALUE[pad[starts + k]] * _STEP[k]
            if k + 1 in STEMS:
                on = np.flatnonzero(size > k)
                out.append((on, mix(total[on] + np.uint64(k + 1))))
    return out


@dataclass(frozen=True)
class Lexicon:
    """Sorted stem hashes, their log odds, and a table of the hashes' low bits that settles most lookups."""

    hashes: np.ndarray
    weights: np.ndarray

    def word_weights(self, low, starts, ends, whole) -> tuple[np.ndarray, np.ndarray]:
        """Largest weight of a word's stems (0: none), and the stem that has it."""
        best, which = np.zeros(len(starts)), np.zeros(len(starts), np.uint64)
        if not len(self.hashes):
            return best, which
        table = np.zeros(1 << 18, bool)
        table[(self.hashes & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        for words, h in stems(low, starts, ends, whole):
            maybe = np.flatnonzero(table[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[maybe]
            w, value = words[maybe[hit]], self.weights[at[hit]]
            better = value > best[w]
            best[w[better]], which[w[better]] = value[better], h[maybe[hit]][better]
        return best, which


def feature_matrix(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row a text, columns as FEATURES."""
    n, low = len(offsets) - 1, LOWERED[data]
    starts, ends, h = _letter_words(low, offsets)
    cut = np.searchsorted(starts, offsets)
    words = np.diff(cut)
    row = np.repeat(np.arange(n), words)
    weight, stem = lexicon.word_weights(low, starts, ends, h)
    hit = np.flatnonzero(weight > 0)
    listed = np.bincount(row[hit], minlength=n)
    strongest = np.zeros(n)
    np.maximum.at(strongest, row[hit], weight[hit])
    with np.errstate(over="ignore"):
        _, first = np.unique(mix(h[hit] + row[hit].astype(np.uint64) * _STEP[0]), return_index=True)
    kinds = np.bincount(row[hit][first], minlength=n)
    second = np.flatnonzero(np.isin(h, _second_person()))
    near = np.zeros(len(hit), bool)
    if len(second) and len(hit):
        for side in (0, 1):
            other = np.clip(np.searchsorted(second, hit) - side, 0, len(second) - 1)
            near |= (np.abs(second[other] - hit) <= NEAR) & (row[second[other]] == row[hit])
    count = byte_counts(data, offsets).astype(np.float64)
    chars = np.maximum(count[:, :8].sum(axis=1), 1)
    inner = np.isin(_KIND[data], (DIGIT, SYMBOL))
    swap = np.zeros(len(data), bool)
    if len(data) > 2:
        swap[1:-1] = inner[1:-1] & _LETTER[data[:-2]] & _LETTER[data[2:]]
    swapped = np.diff(np.append(0, np.cumsum(swap))[offsets])
    w = np.maximum(words, 1).astype(np.float64)
    return np.column_stack([
        np.log1p(words), listed, listed / w, strongest, np.bincount(row[hit], weight[hit], n) / w, kinds,
        np.bincount(row[second], minlength=n) / w, np.bincount(row[hit][near], minlength=n) / w,
        count[:, UPPER] / np.maximum(count[:, LOWER] + count[:, UPPER], 1), count[:, PUNCT] / chars, count[:, SHOUT] / chars,
        count[:, SYMBOL] / chars, swapped / w, count[:, DIGIT] / chars])


def _stem_counts(rows: DataFrame, table: np.ndarray | None) -> DataFrame:
    """(stem, fold, label, n): documents of (fold, text, label) that have a stem; sums within slices come first.

    ``table``: by the low bits of a stem's hash, whether the stem may be of interest.
    """
    sent = None if table is None else rows.sparkSession.sparkContext.broadcast(table)  # 2 ** TABLE_BITS flags

    def run(batches):
        for b in batches:
            fold, label = np.asarray(b.column(0)), np.asarray(b.column(2)).astype(np.int64)
            for lo, hi, data, offsets in slices(b.column(1)):
                low = LOWERED[data]
                starts, ends, h = _letter_words(low, offsets)
                row = np.searchsorted(offsets, starts, side="right") - 1
                found, owner = [], []
                for words, s in stems(low, starts, ends, h):
                    if sent is not None:
                        on = sent.value[(s & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)]
                        words, s = words[on], s[on]
                    found.append(s)
                    owner.append(row[words])
                s, r = np.concatenate(found), np.concatenate(owner)
                order = np.lexsort((s, r))
                s, r = s[order], r[order]
                new = np.append(True, (s[1:] != s[:-1]) | (r[1:] != r[:-1]))[:len(s)]
                s, group = s[new], fold[lo + r[new]] * 2 + label[lo + r[new]]
                order = np.lexsort((group, s))
                s, group = s[order], group[order]
                first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (group[1:] != group[:-1]))[:len(s)])
                n = np.diff(np.append(first, len(s)))
                yield pa.record_batch([pa.array(s[first].view(np.int64)), pa.array(group[first] // 2), pa.array(group[first] % 2), pa.array(n)],
                                      ["stem", "fold", "label", "n"])
    counts = rows.select("fold", "text", "label").mapInArrow(run, "stem bigint, fold bigint, label bigint, n bigint")
    return counts.groupBy("stem", "fold", "label").agg(F.sum("n").alias("n"))


def _flags(stems_: DataFrame) -> np.ndarray:
    """Flags of the low ``TABLE_BITS`` bits of the stems: a table of fixed size, gathered in pages."""
    low = F.col("stem").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    pages = (stems_.select((low / 32768).cast("int").alias("page"), (low % 32768).alias("bit")).groupBy("page")
             .agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    table = np.zeros(1 << TABLE_BITS, bool)
    for r in pages:
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8)[:4096], bitorder="little")
        table[r.page * 32768:(r.page + 1) * 32768] = bits.astype(bool)
    return table


def stem_evidence(rows: DataFrame) -> DataFrame:
    """(stem, c<fold>_<label> ...): documents of each fold and label that have it, for stems of at least ``TOXIC`` toxic documents."""
    toxic = stored(_stem_counts(rows.where("label = 1"), None).groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= TOXIC).select("stem"), "toxic_stems")
    cells = [F.sum(F.when((F.col("fold") == f) & (F.col("label") == k), F.col("n")).otherwise(0)).alias(f"c{f}_{k}") for f in range(FOLDS) for k in (0, 1)]
    return _stem_counts(rows, _flags(toxic)).join(toxic, "stem", "left_semi").groupBy("stem").agg(*cells)


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """One lexicon without each fold, and last the lexicon of all folds, from staged (fold, text, label) rows.

    Both labels' documents are counted for every stem before any is chosen: a stem enters with at least ``TOXIC`` toxic documents
    and a log odds ratio of at least ``ODDS``; the ``LEXICON`` stems of largest log odds times toxic documents stay.
    """
    evidence = stored(stem_evidence(rows), "stem_evidence")
    total = np.zeros((FOLDS, 2))
    for r in rows.groupBy("fold", "label").count().collect():  # folds x labels
        total[r.fold, r.label] = r["count"]
    out = []
    for left_out in [*range(FOLDS), None]:
        folds = [f for f in range(FOLDS) if f != left_out]
        clean, toxic = (sum(F.col(f"c{f}_{k}") for f in folds) for k in (0, 1))
        size = total[folds].sum(axis=0)
        odds = F.log((toxic + 0.5) / float(size[1] + 1)) - F.log((clean + 0.5) / float(size[0] + 1))
        good = evidence.select("stem", toxic.alias("t"), odds.alias("odds")).where((F.col("t") >= TOXIC) & (F.col("odds") >= ODDS))
        best = good.orderBy(F.desc(F.col("odds") * F.col("t")), "stem").limit(LEXICON).collect()
        hashes = np.array([r.stem for r in best], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        out.append(Lexicon(hashes[order], np.array([r.odds for r in best], np.float64)[order]))
    return out


def with_features(rows: DataFrame, lexicons: list[Lexicon], text: str, folded: bool) -> DataFrame:
    """``rows`` without the text and with ``_x``; ``folded``: by the lexicon without the fold that the first column names."""
    where = rows.columns.index(text)
    keep = [c for c in rows.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text] + ["_x array<double>"])
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)  # at most (FOLDS + 1) x LEXICON pairs of numbers

    def run(batches):
        for b in batches:
            fold = np.asarray(b.column(0)) if folded else None
            for lo, hi, data, offsets in slices(b.column(where)):
                if folded:
                    x = np.empty((hi - lo, len(FEATURES)))
                    for f in range(FOLDS):
                        on = np.flatnonzero(fold[lo:hi] == f)
                        x[on] = feature_matrix(data, offsets, shared.value[f])[on]
                else:
                    x = feature_matrix(data, offsets, shared.value[-1])
                first = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                cols = [b.column(i).slice(lo, hi - lo) for i in range(b.num_columns) if i != where]
                yield pa.record_batch([*cols, pa.ListArray.from_arrays(pa.array(first), pa.array(x.ravel()))], [*keep, "_x"])
    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Scorer:
    lexicons: list[Lexicon]
    trees: object
    calibration: object


def fit(rows: DataFrame, trees: int = 20, depth: int = 3) -> Scorer | float:
    """The scorer of (id, text, label) rows, or the share of label 1 where a class has too few rows."""
    rows = stored(rows.select(F.pmod(F.xxhash64("id"), F.lit(FOLDS)).alias("fold"), "text", "label", (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) == 0).alias("later")), "toxicity_rows")
    lexicons = learn_lexicons(rows)
    x = stored(with_features(rows, lexicons, "text", True).select("label", array_to_vector("_x").alias("features"), "later").coalesce(4), "toxicity_features")
    size = {(r.label, r.later): r["count"] for r in x.groupBy("label", "later").count().collect()}
    n = [sum(v for (label, _), v in size.items() if label == k) for k in (0, 1)]
    if min(n) < 2:
        return n[1] / sum(n) if sum(n) else 0.0
    apart = all(size.get((k, later), 0) >= 20 for k in (0, 1) for later in (True, False))
    first, second = (x.where("not later"), x.where("later")) if apart else (x, x)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, minInstancesPerNode=2, seed=5).fit(first)
    raw = model.transform(second).select(F.col("label").cast("double"), vector_to_array("probability")[1].alias("p"))
    return Scorer(lexicons, model, IsotonicRegression(labelCol="label", featuresCol="p", predictionCol="fitted").fit(raw))


def scored(docs: DataFrame, model: Scorer | float, text: str = "text") -> DataFrame:
    """``docs`` without the text and with ``_score``; a thousandth of the trees' own probability orders tied scores."""
    if isinstance(model, float):
        return docs.drop(text).withColumn("_score", F.lit(model))
    d = with_features(docs, model.lexicons, text, False).withColumn("features", array_to_vector("_x")).drop("_x")
    d = model.trees.transform(d).withColumn("p", vector_to_array("probability")[1])
    d = model.calibration.transform(d)
    return d.withColumn("_score", 0.999 * F.least(F.greatest("fitted", F.lit(0.0)), F.lit(1.0)) + 0.001 * F.col("p"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, bound: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    model = fit(training_rows(docs, labels, "toxic", text, id_col, bound))
    d = scored(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), model)
    return d.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), F.col("_score").alias("score"),
                    (F.col("_score") >= threshold).cast("int").alias("predicted"))

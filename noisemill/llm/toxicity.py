"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import LOWER_VALUES, batch, buffers, fold, id_text, slices, span_hashes, words

#: Everything but ASCII letters and the bytes of other letters parts words.
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = _NOT_LETTER[128:] = False
_PREFIX = 5
EXCESS = 5.0


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word and of each longer word's first five bytes, A-Z as a-z."""
    data, offsets = buffers(column)
    starts, ends, rows = words(data, offsets, _NOT_LETTER)
    long = np.flatnonzero(ends - starts > _PREFIX)
    values = LOWER_VALUES[data]
    prefixes = span_hashes(values, starts[long], starts[long] + _PREFIX) ^ np.uint64(1)
    return np.concatenate([span_hashes(values, starts, ends), prefixes]), np.concatenate([rows, rows[long]])


def _hits(known: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in ``known``, which is sorted, of each of its features that a row holds, once, by row."""
    if not len(known) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = np.flatnonzero(known[at] == hashes)
    pairs = np.unique(rows[hit] * len(known) + at[hit])
    return pairs // len(known), pairs % len(known)


_COUNTED = pa.schema([("hash", pa.int64()), ("in_p", pa.int64()), ("in_u", pa.int64())])


def _text_counts(batches):
    """In how many positive and unlabelled texts of a slice each feature is."""
    for x in slices(batches):
        hashes, rows = _features(x.column("text"))
        order = np.lexsort((rows, hashes))
        hashes, rows = hashes[order], rows[order]
        first = np.ones(len(rows), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        names, at = np.unique(hashes[first], return_inverse=True)
        positive = x.column("positive").to_numpy(zero_copy_only=False).astype(bool)
        in_p = np.bincount(at, positive[rows[first]], len(names)).astype(np.int64)
        yield batch(_COUNTED, names.view(np.int64), in_p, np.bincount(at, minlength=len(names)) - in_p)


@dataclass
class ToxicityModel:
    """A weight for each feature that a text may hold, by sorted hash, and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def margins(self, column: pa.Array) -> np.ndarray:
        hashes, rows = _features(column)
        out = np.full(len(column), self.bias)
        rows, at = _hits(self.hashes, hashes, rows)
        if len(at):
            out += np.bincount(rows, self.weights[at], len(column))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier that minimises the non-negative PU risk.

    The risk is prior * E+[loss(g)] + max(0, Eu[loss(-g)] - prior * E+[loss(-g)]): the unlabelled
    rows stand for the negatives, and the prior takes out the positives among them. When that
    difference goes below zero, the step undoes it instead of the whole risk's gradient.
    """
    p, u = x[positive], x[~positive]
    w, bias = np.zeros(x.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    moments = np.zeros((2, x.shape[1] + 1))
    for t in range(1, steps + 1):
        gp, gu = p @ w + bias, u @ w + bias
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up, down = (-_sigmoid(-gp) / len(p), _sigmoid(gp) / len(p))
        unlabelled = _sigmoid(gu) / len(u)
        if negative >= 0:
            cp, cu = prior * up - prior * down, unlabelled
        else:
            cp, cu = prior * down, -unlabelled
        grad = np.append(p.T @ cp.astype(np.float32) + u.T @ cu.astype(np.float32) + decay * w, cp.sum() + cu.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        step = rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
        w, bias = (w - step[:-1]).astype(np.float32), bias - step[-1]
    return w.astype(float), float(bias)


def train(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 6000, features: int = 1024, hold_out: tuple[int, int] | None = None) -> ToxicityModel:
    """Learn from texts that ``labels`` marks toxic, and from texts taken as unlabelled.

    The classifier is fitted on a bounded sample: at most ``positives`` confirmed toxic texts and
    ``unlabelled`` others, those with the least hash of the id. The class prior is the share of
    toxic labels, over all label rows in use. Words and word beginnings become features if three
    positive texts hold them, and ``EXCESS`` standard deviations more than unlabelled texts would;
    the ``features`` with the largest excess stay. With ``hold_out`` = (modulus, remainder)
    neither labels nor texts of such ids are seen. Without a positive text the model gives each
    text the prior. A document with several labels is toxic if one says so; null labels don't count.

    After the fit the bias is cut down to the prior's log odds, which is no part of the risk: with few
    positives the risk alone leaves it higher, and a text that holds no feature would be called toxic.
    """
    if hold_out:
        labels, docs = (x.where(fold("doc_id", hold_out[0]) != hold_out[1]) for x in (labels, docs))
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows, toxic = marks.agg(F.count("*"), F.sum("toxic")).first()
    prior = ((toxic or 0) + 0.5) / (rows + 1) if rows else 0.1
    draw = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = marks.where("toxic = 1").select("doc_id").orderBy(draw, "doc_id").limit(positives).withColumn("positive", F.lit(True))
    rest = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(draw, "doc_id").limit(unlabelled).withColumn("positive", F.lit(False))
    # the sample has at most positives + unlabelled ids: small enough to broadcast at any size of the corpus
    sample = id_text(docs).join(F.broadcast(chosen.unionByName(rest)), "doc_id").select("text", "positive")
    n_p, n_u = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n_p or not n_u:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))), prior)
    # features are counted and chosen in Spark: texts of any length send the driver the chosen ones only
    usual = (F.col("in_u") + 1) / (n_u + 2)
    excess = (F.col("in_p") - n_p * usual) / F.sqrt(n_p * usual * (1 - usual))
    counted = sample.mapInArrow(_text_counts, "hash long, in_p long, in_u long").groupBy("hash").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
    best = counted.where("in_p >= 3").select("hash", excess.alias("excess")).where(F.col("excess") >= EXCESS)
    names = np.sort(np.array([r.hash for r in best.orderBy(F.desc("excess"), "hash").limit(features).collect()], np.int64).view(np.uint64))
    schema = pa.schema([("positive", pa.bool_()), ("features", pa.binary())])

    def chosen_of(batches):
        for x in slices(batches):
            rows, at = _hits(names, *_features(x.column("text")))
            parts = np.split(at.astype(np.int32), np.searchsorted(rows, np.arange(1, x.num_rows)))
            yield batch(schema, x.column("positive"), [part.tobytes() for part in parts])

    seen = sample.mapInArrow(chosen_of, "positive boolean, features binary").collect()
    positive = np.array([r.positive for r in seen], bool)
    x = np.zeros((len(seen), len(names)), np.float32)
    for k, r in enumerate(seen):
        x[k, np.frombuffer(r.features, np.int32)] = 1
    weights, bias = fit_nnpu(x, positive, prior)
    bias = min(bias, float(np.log(prior / (1 - prior))))
    return ToxicityModel(names, weights, bias, prior)


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for each row: how likely the whole text is toxic, 0 to 1.

    A null or empty text gets what the model gives a text without features.
    """

    def run(batches):
        for x in slices(batches):
            yield batch(_OUT, x.column("doc_id"), _sigmoid(model.margins(x.column("text"))))

    return id_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def remove_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns.

    Each row is judged by its own text: repeated rows stay or go alike, a score of exactly ``threshold``
    goes, a null or empty text is one without features. Texts are read in slices of bounded size, a very
    long one alone; an empty table stays empty.
    """

    @F.arrow_udf("boolean")
    def keeps(text: pa.Array) -> pa.Array:
        parts = [model.margins(x.column(0)) for x in slices(iter([pa.record_batch([text], ["text"])]))]
        return pa.array(_sigmoid(np.concatenate(parts)) < threshold if parts else [], pa.bool_())

    return docs.where(keeps(F.coalesce(F.col("text"), F.lit(""))))

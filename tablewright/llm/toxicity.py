"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

The positives are confirmed toxic texts, everything else is unlabelled. With the class
prior p, positive risk ``R+`` and negative risk ``R-``, the risk of all texts is

    p R+(positives) + max(0, R-(unlabelled) - p R-(positives))

The second term estimates the risk on clean texts; where training would push it below
zero (it can't be), the step goes back up instead. The model is linear over hashed
tokens that a text contains, words and the beginnings of longer ones (inflected and
compound forms share those), with an L1 penalty, so few tokens carry weight. It is
fitted in numpy on the driver from bounded samples and scores all texts on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.names import free_name, ref
from .common import lists, map_texts, stage
from .kernels import PARTED, batches, beginnings, words

BUCKETS = 1 << 20
POSITIVES, UNLABELLED = 6_000, 12_000  # most texts of each sample
ROUNDS, RATE, PENALTY, REFIT = 200, 0.05, 0.026, 0.2
BEGINNINGS = (5, 7)  # bytes of a word's beginning that is a token beside the word
LEAST_TEXTS = 3  # a token counts from this many sampled texts on


@dataclass(frozen=True)
class Model:
    """Weights by token bucket; the bias is the last. ``prior`` is the share of toxic texts assumed."""

    weights: np.ndarray
    bias: float
    prior: float


def _occurrences(raws):
    """(text index, bucket) of every token, repeated ones too."""
    w = words(raws, lower=True, breaks=PARTED)
    found = [(w.text, w.hash), *[beginnings(w, n) for n in BEGINNINGS]]
    text, hashes = (np.concatenate(x) for x in zip(*found))
    return text.astype(np.int64), (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _tokens(raws):
    """(text index, bucket) of every distinct token of each text, ordered."""
    text, bucket = _occurrences(raws)
    return np.divmod(np.unique(text * BUCKETS + bucket), BUCKETS)


def _features(batch: pa.RecordBatch):
    texts = batch.column(1).to_pylist()
    for begin, raws in batches(texts):
        text, bucket = _tokens(raws)
        own = lists(bucket.astype(np.int32), np.bincount(text, minlength=len(raws)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(raws)), own], ["toxic", "tokens"])


def _scores(batch: pa.RecordBatch, model, name: str):
    weights, bias = model.value
    texts, out = batch.column(batch.num_columns - 1).to_pylist(), []
    for _, raws in batches(texts):
        text, bucket = _occurrences(raws)
        heavy = np.flatnonzero(weights[bucket])
        key = np.unique(text[heavy] * BUCKETS + bucket[heavy])
        z = bias + np.bincount(key // BUCKETS, weights[key % BUCKETS], len(raws))
        out.append(1 / (1 + np.exp(-np.clip(z, -60, 60))))
    score = np.concatenate(out) if out else np.zeros(0)
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], name])


def _descend(text, column, positive, prior: float, width: int, penalty: float):
    """Proximal Adam on the non-negative risk; returns weights and bias."""
    n, w, bias = len(positive), np.zeros(width), np.log(prior / (1 - prior))
    share = np.where(positive, 1 / max(1, positive.sum()), 1 / max(1, (~positive).sum()))
    moment, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, ROUNDS + 1):
        z = bias + np.bincount(text, w[column], n)
        s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        loss = np.logaddexp(0, z)  # as a negative
        clean = (share * loss)[~positive].sum() - prior * (share * loss)[positive].sum()
        up = np.where(positive, -prior * share * (1 - s), 0)  # slope of p R+
        down = np.where(positive, -prior * share * s, share * s)  # slope of the risk on clean texts
        slope = up + down if clean >= 0 else -down
        grad = np.append(np.bincount(column, slope[text], width), slope.sum())
        moment, second = 0.9 * moment + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        pace = RATE / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        move = pace * moment / (1 - 0.9**step)
        w = w - move[:-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - penalty * pace[:-1])
        bias -= move[-1]
    return w, bias


def fit(tokens: list[np.ndarray], positive: np.ndarray, prior: float) -> Model:
    """Fits the weights on distinct token buckets of each text; ``positive`` marks the confirmed ones."""
    bucket = np.concatenate(tokens)
    text = np.repeat(np.arange(len(tokens), dtype=np.int32), [len(t) for t in tokens])
    common = np.bincount(bucket, minlength=BUCKETS) >= LEAST_TEXTS
    kept = common[bucket]
    used, place = np.flatnonzero(common), np.cumsum(common, dtype=np.int32) - 1
    text, column = text[kept], place[bucket[kept]]
    del bucket, kept
    penalty = PENALTY / np.sqrt(positive.sum())  # as the noise of a token's share among the positives
    w, bias = _descend(text, column, positive, prior, len(used), penalty)
    # The penalty chooses the tokens but also shrinks them: those with weight are fitted again.
    chosen = w != 0
    inside = chosen[column]
    used, renamed = used[chosen], np.cumsum(chosen) - 1
    w, bias = _descend(text[inside], renamed[column[inside]], positive, prior, len(used), penalty * REFIT)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return Model(weights, float(bias), prior)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learns from ``labels`` (doc_id, toxic) and the texts of ``docs``; labels of held-out documents must not be among them.

    The class prior is the share of toxic rows among the labels; otherwise only rows with
    ``toxic = 1`` are used. Of these and of all texts, samples of at most ``positives`` and
    ``unlabelled`` documents are drawn by a hash of the id, of rows that share one the
    text first in order. Without a toxic row, or without
    a clean one, the scores are constant: the prior.
    """
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    shares = labels.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()
    prior = shares[1] / shares[0] if shares[0] else 0.0
    constant = Model(np.zeros(BUCKETS, np.float32), -60.0 if prior == 0 else 60.0, prior)
    if prior in (0.0, 1.0):
        return constant
    draw = lambda ids, n: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    marked = draw(labels.filter("toxic = 1").select("doc_id").distinct(), positives).withColumn("toxic", F.lit(1))
    others = draw(docs.select("doc_id").filter("doc_id is not null").distinct(), unlabelled).withColumn("toxic", F.lit(0))
    wanted = stage(marked.union(others))  # at most positives + unlabelled ids
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")  # the bound holds for rows too
    sample = stage(map_texts(rows, _features, "toxic int, tokens array<int>")).toArrow()
    toxic, tokens = sample.column("toxic").to_numpy(), sample.column("tokens").combine_chunks()
    if not toxic.any() or toxic.all():
        return constant
    offsets, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
    del sample, tokens
    parts = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    # The order of collected rows varies with the partitioning, and float sums with it.
    order = sorted(range(len(parts)), key=lambda i: (toxic[i], sha256(parts[i]).digest()))
    return fit([parts[i] for i in order], toxic[order] == 1, prior)


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` and ``name``: the chance that the text is toxic. Null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    columns = docs.select(*[ref(c) for c in keep], F.col("text").alias(free_name("scored_text", [*keep, name])))
    fields = [(f.name.replace("`", "``"), f.dataType.simpleString()) for f in columns.schema.fields[:-1]]
    schema = ", ".join(f"`{n}` {t}" for n, t in fields)
    return map_texts(columns, partial(_scores, model=shared, name=name), f"{schema}, `{name}` double")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learns from labels that aren't held out.

    Scores depend on the text alone. Repeated rows, rows without an id and empty texts
    are scored like others; an empty table gives none.
    """
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    out = score(docs.select(F.col("doc_id"), "text"), model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    name = free_name("toxicity", docs.columns)
    return score(docs, model, docs.columns, name).filter(ref(name) < 0.5).drop(name)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

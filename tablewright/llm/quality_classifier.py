"""Quality by co-training (Blum and Mitchell, 1998).

Two logistic classifiers see different views of a page: the *content* view has its words
and marks, the *metadata* view its source, language, length and layout. Both begin with
the labelled pages. In every round each classifier labels the pages of an unlabelled pool
of which it is surest, in the proportion of the classes, and gives them to the other one to
learn from. In the end each view is calibrated on labelled pages that took no part, and
the calibrated views are weighed against each other on the same pages. All pages are
scored on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, map_texts, stage
from .kernels import PARTED, batches, words
from .toxicity import held_out

BUCKETS = 1 << 16
LABELLED, POOL = 4_000, 8_000  # most pages of the labelled sample and of the unlabelled pool
ROUNDS, GIVEN = 4, 0.04  # share of the pool that a view labels in a round
STEPS, RATE, RIDGE = 80, 0.1, 1e-3
VIEWS = ("content", "metadata")
# Bytes of runs of marks: neither letters, digits, white space nor beyond ASCII.
_MARKS = np.array([not (33 <= b < 127 and not chr(b).isalnum()) for b in range(256)])
_UPPER = np.array([65 <= b < 91 for b in range(256)])


def _bucket(view: str, *values) -> int:
    import zlib

    return zlib.crc32("\x00".join([view, *map(str, values)]).encode()) % BUCKETS


def _content(raws) -> list[np.ndarray]:
    """Hashed words, runs of marks, and classes of word length, capitals and variety."""
    parts = [words(raws, lower=True, breaks=PARTED), words(raws, breaks=_MARKS)]
    plain, sets = words(raws), []
    for i, raw in enumerate(raws):
        own = [(w.hash[w.first[i] : w.first[i + 1]] & np.uint64(BUCKETS - 1)).astype(np.int64) for w in parts]
        tokens = plain.hash[plain.first[i] : plain.first[i + 1]]
        n = max(1, len(tokens))
        capitals = int(_UPPER[np.frombuffer(raw, np.uint8)].sum())
        classes = [_bucket("length", min(12, len(raw) // n)), _bucket("capitals", 10 * capitals // max(1, len(raw))), _bucket("variety", 10 * len(np.unique(tokens)) // n)]
        sets.append(np.unique(np.concatenate([*own, classes])))
    return sets


def _metadata(raws, sources, langs) -> list[np.ndarray]:
    """Source, language, classes of length and of the lines' number and length."""
    out = []
    for raw, source, lang in zip(raws, sources, langs):
        lines = raw.count(b"\n") + 1
        values = {"source": source, "lang": lang, "bytes": len(raw).bit_length(), "lines": lines.bit_length(), "line": (len(raw) // lines).bit_length()}
        out.append(np.unique([_bucket(k, v) for k, v in values.items()] + [_bucket("both", values["bytes"], values["lines"])]))
    return out


def _views(batch: pa.RecordBatch, at: int):
    """(first row, content sets, metadata sets) of runs of a batch with text, source and lang from column ``at`` on."""
    texts, sources, langs = [batch.column(at + k).to_pylist() for k in range(3)]
    for begin, raws in batches(texts):
        stop = begin + len(raws)
        yield begin, _content(raws), _metadata(raws, sources[begin:stop], langs[begin:stop])


def _features(batch: pa.RecordBatch):
    for begin, content, metadata in _views(batch, 1):
        sides = [lists(np.concatenate(s).astype(np.int32), [len(x) for x in s], pa.int32()) for s in (content, metadata)]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(content)), *sides], ["label", *VIEWS])


def _flat(sets):
    size = np.array([len(s) for s in sets], int)
    return np.repeat(np.arange(len(sets)), size), np.concatenate([np.zeros(0, np.int64), *sets]).astype(np.int64)


def _logits(sets, weights, bias) -> np.ndarray:
    row, column = _flat(sets)
    size = np.sqrt(np.maximum(1, np.bincount(row, minlength=len(sets))))
    return bias + np.bincount(row, weights[column], len(sets)) / size


def logistic(sets, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by bucket and bias; a page's features share a unit length."""
    row, column = _flat(sets)
    used, column = np.unique(column, return_inverse=True)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(sets))))
    w, bias, n = np.zeros(len(used)), 0.0, len(sets)
    moment, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(row, w[column], n) * scale
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        grad = np.append(np.bincount(column, (error * scale)[row], len(used)) / n + RIDGE * w / np.sqrt(n), error.mean())
        moment, second = 0.9 * moment + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return weights, float(bias)


def platt(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibrated log odds, by Newton steps with smoothed targets."""
    positive = labels.sum()
    goal = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([((p - goal) * z).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(hessian, g)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.0)), float(b)


def weigh(odds: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """A weight for each column of calibrated log odds, and an offset: a logistic fit drawn towards equal weights.

    Newton steps, halved until the loss falls. No weight is below zero: columns that would get one are left out.
    """
    n, k = odds.shape
    x, start = np.column_stack([odds, np.ones(n)]), np.append(np.full(k, 1 / max(1, k)), 0.0)

    def loss(beta):
        z = x @ beta
        return (np.logaddexp(0, z) - labels * z).sum() + ((beta - start) ** 2).sum() / 2

    beta = start
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.eye(k + 1), x.T @ (p - labels) + beta - start)
        while np.abs(step).max() > 1e-9 and loss(beta - step) > loss(beta):
            step = step / 2
        beta = beta - step
        if np.abs(step).max() <= 1e-9:
            break
    kept = beta[:-1] > 0
    if not kept.all():
        *some, offset = weigh(odds[:, kept], labels)
        weights = np.zeros(k)
        weights[kept] = some
        return (*weights.tolist(), offset)
    return tuple(beta.tolist())


@dataclass(frozen=True)
class Model:
    """Per view: weights, bias, slope and offset; and the weights and the offset that combine the views' log odds."""

    views: tuple
    mix: tuple


def co_train(content, metadata, labels: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``labels`` is 1 or 0, or -1 for the pages of the pool. Every fourth labelled page is kept for calibration."""
    sides = {"content": content, "metadata": metadata}
    marked, pool = np.flatnonzero(labels >= 0), np.flatnonzero(labels < 0)
    kept, train = marked[3::4], np.delete(marked, np.s_[3::4])
    share = labels[marked].mean()
    known = {v: dict(zip(train.tolist(), labels[train].tolist())) for v in VIEWS}
    take = lambda side, rows: [side[i] for i in rows]
    learn = lambda v: logistic(take(sides[v], known[v]), np.array(list(known[v].values()), float))
    fitted = {v: learn(v) for v in VIEWS}
    for _ in range(rounds):
        gifts = {}
        for v, other in (VIEWS, VIEWS[::-1]):
            rest = np.array([i for i in pool.tolist() if i not in known[other]], int)
            if not len(rest):
                continue
            order = rest[np.argsort(_logits(take(sides[v], rest), *fitted[v]), kind="stable")]
            each = max(2, int(GIVEN * len(pool)))
            good, bad = max(1, int(each * share)), max(1, int(each * (1 - share)))
            gifts[other] = {**dict.fromkeys(order[:bad].tolist(), 0), **dict.fromkeys(order[-good:].tolist(), 1)}
        for v, gift in gifts.items():
            known[v] |= gift
        fitted = {v: learn(v) for v in VIEWS}
    z = [_logits(take(sides[v], kept), *fitted[v]) for v in VIEWS]
    views = tuple((*fitted[v], *platt(own, labels[kept])) for v, own in zip(VIEWS, z))
    odds = np.column_stack([np.clip(a * own + b, -30, 30) for own, (_, _, a, b) in zip(z, views)])
    return Model(views, weigh(odds, labels[kept]))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model:
    """Learns from ``labels`` (doc_id, quality) and an unlabelled pool of other documents, both drawn by a hash of the id.

    Of rows that share a drawn id one is read, the first by text, source and language, so the bounds hold for rows too.
    With fewer than eight labelled pages, or pages of one class only, the scores are constant.
    """
    draw = lambda ids, n: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    marked = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    marked = stage(draw(marked, labelled))
    others = docs.select("doc_id").filter("doc_id is not null").join(labels.select("doc_id"), "doc_id", "left_anti").distinct()
    wanted = stage(marked.union(draw(others, pool).withColumn("label", F.lit(-1))))  # at most labelled + pool ids
    rows = docs.select("doc_id", F.struct("text", "source", "lang").alias("page")).join(F.broadcast(wanted), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("page").alias("page")).select("label", "page.*")
    found = stage(map_texts(rows, _features, "label int, content array<int>, metadata array<int>")).toArrow()
    label, sides = found.column("label").to_numpy(), []
    for v in VIEWS:
        side = found.column(v).combine_chunks()
        ends, flat = side.offsets.to_numpy(), side.values.to_numpy().astype(np.int64)
        sides.append([flat[a:b] for a, b in zip(ends[:-1], ends[1:])])
    # The order of collected rows varies with the partitioning; what is learnt doesn't.
    order = sorted(range(len(label)), key=lambda i: (label[i], sides[0][i].tobytes(), sides[1][i].tobytes()))
    order.sort(key=lambda i: _bucket("order", sides[0][i].tobytes()))
    label = label[order]
    if (label >= 0).sum() < 8 or len(set(label[label >= 0][3::4])) < 2 or len(set(np.delete(label[label >= 0], np.s_[3::4]))) < 2:
        share = float((label == 1).sum() + 1) / float((label >= 0).sum() + 2)
        return Model(tuple((np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share)))) for _ in VIEWS), (0.5, 0.5, 0.0))
    return co_train(*[[side[i] for i in order] for side in sides], label)


def _scored(batch: pa.RecordBatch, model):
    m, columns = model.value, [[], [], []]
    for _, content, metadata in _views(batch, 1):
        odds = [np.clip(a * _logits(s, w, bias) + b, -30, 30) for s, (w, bias, a, b) in zip((content, metadata), m.views)]
        for k, z in enumerate([*odds, m.mix[0] * odds[0] + m.mix[1] * odds[1] + m.mix[2]]):
            columns[k].append(1 / (1 + np.exp(-z)))
    flat = [pa.array(np.concatenate(c) if c else np.zeros(0)) for c in columns]
    return pa.RecordBatch.from_arrays([batch.column(0), *flat], ["doc_id", "content_score", "metadata_score", "score"])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, content_score, metadata_score, score, predicted) of every document.

    Needs doc_id, text, source and lang; labels of held-out documents aren't learnt from.
    Null texts count as empty, null sources and languages as values of their own.
    Repeated rows and rows without an id are scored; an empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels.filter(~held_out(F.col("doc_id")))))
    rows = docs.select(F.col("doc_id").cast("long"), "text", "source", "lang")
    out = map_texts(rows, partial(_scored, model=model), "doc_id long, content_score double, metadata_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

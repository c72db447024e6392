"""Quality classifier: co-training of two views.

The content view sees a text's byte pairs (hashed shares) and repetition, and nothing else; the metadata view sees what the tables know of the
page without its text: source, language and n_chars. Neither sees a column of the other. Both are logistic regressions fitted on the driver on
at most ``train_rows`` labelled documents (a bounded sample: the first by a hash of doc_id). Over ``rounds`` each view scores all unlabelled
documents, wherever they are, and gives the other view the ``per_round`` of them that it is most confident of (both classes, in the labelled share),
with its labels. Each view is calibrated (Platt) on labelled rows kept out of training, in every round too: how sure a view is, is judged on its calibrated logits, so that
one that knows little gives nothing. The calibrated views are combined by a logistic regression on
their logits, fitted there too. Features are worked out where the texts are; only chosen documents' features travel. All documents are
scored on whole texts.

Defined results: null text is empty, null source, language and n_chars are values of their own; without labels of both classes every
document scores 1 (nothing is known against it); several labels of a doc_id count by their mean, rounded up at a half; rows of one doc_id
are scored each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm._common import Scratch, lean, read_table, release

TRAIN_ROWS = 4_000
ROUNDS = 3
RIDGE = 0.03
PER_ROUND = 250
CONFIDENT = 0.95
KEEP_FROM = 0.5
PAIRS = 1024
META = 128
_CLASS = np.array([*([0] * 9), 1, 2, 0, 0, 3, *([0] * 18), 1, *([4] * 15), *([5] * 10), *([4] * 7), *([6] * 26), *([4] * 6), *([7] * 26), *([4] * 5), *([8] * 128)])


def content(data: bytes) -> np.ndarray:
    """Content features: square roots of hashed byte-pair shares, character classes' shares, and repetition."""
    out = np.zeros(PAIRS + 16, np.float32)
    if not data:
        return out
    b = np.frombuffer(data, np.uint8)
    pair = (b[:-1].astype(np.uint32) * 40503 + b[1:].astype(np.uint32) * 30011) % PAIRS
    out[:PAIRS] = np.sqrt(np.bincount(pair, minlength=PAIRS) / len(b))
    out[PAIRS : PAIRS + 9] = np.sqrt(np.bincount(_CLASS[b], minlength=9) / len(b))
    words, lines = data.split(), data.split(b"\n")
    distinct = len(set(words))
    out[PAIRS + 9] = distinct / max(len(words), 1)
    out[PAIRS + 10] = distinct / max(len(words), 1) ** 0.8
    out[PAIRS + 11] = len(set(lines)) / len(lines)
    out[PAIRS + 12] = min(len(data) / max(len(words), 1), 40) / 40
    out[PAIRS + 13] = np.count_nonzero(b[1:] == b[:-1]) / len(b)
    out[PAIRS + 14] = 1.0 if len(words) < 10 else 0.0
    out[PAIRS + 15] = sum(1 for x, y in zip(words, words[1:]) if x == y) / max(len(words), 1)
    return out


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Metadata features: hashed source, language, their pair, and length."""
    out = np.zeros(META, np.float32)
    key = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass")) % (META - 8)
    size = np.log1p(max(n_chars or 0, 0))
    for name in (f"source={source}", f"lang={lang}", f"both={source}/{lang}", f"size={'?' if n_chars is None else int(2 * size)}"):
        out[key(name)] += 1
    out[-8:] = size / 10, size * size / 100, (n_chars or 0) <= 0, (n_chars or 0) > 10_000, n_chars is None, source is None, lang is None, 1
    return out


def _dot(z: np.ndarray, v: np.ndarray) -> np.ndarray:
    """z @ v in double precision, without a copy of all of z in it."""
    return np.concatenate([z[k : k + 512] @ v for k in range(0, len(z), 512)])


def _turned(z: np.ndarray, v: np.ndarray) -> np.ndarray:
    """z.T @ v, likewise."""
    return sum(z[k : k + 512].T @ v[k : k + 512] for k in range(0, len(z), 512))


class Logistic:
    """Logistic regression by Newton steps with conjugate gradients; inputs are standardised."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 12) -> "Logistic":
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = self._z(x)
        w = np.zeros(z.shape[1])
        share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # the classes weigh alike
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(_dot(z, w), -30, 30)))
            g = _turned(z, share * (p - y)) + ridge * w
            h = share * p * (1 - p) + 1e-9
            step, r = np.zeros_like(w), -g
            d, rr = r.copy(), r @ r
            for _ in range(25):
                if rr < 1e-16:
                    break
                hd = _turned(z, h * _dot(z, d)) + ridge * d
                a = rr / (d @ hd)
                step += a * d
                r -= a * hd
                new = r @ r
                d, rr = r + new / rr * d, new
            w = w + step * min(1.0, 10 / (np.abs(step).max() + 1e-9))
        self.w = w
        return self

    def _z(self, x: np.ndarray) -> np.ndarray:
        z = np.ones((len(x), x.shape[1] + 1), np.float32)
        own = z[:, :-1]
        np.subtract(x, self.mean, out=own)
        np.divide(own, self.scale, out=own)
        np.clip(own, -8, 8, out=own)
        return z

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._z(x) @ self.w, -30, 30)


def platt(logit: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (one a column, then a constant) that turn logits into calibrated ones, by Newton steps."""
    z = np.c_[logit, np.ones(len(y))]
    w = np.r_[np.full(z.shape[1] - 1, 1.0 / (z.shape[1] - 1)), 0.0]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, z.T @ (p - y) / len(y) + ridge * (w - np.r_[np.full(len(w) - 1, 1.0 / (len(w) - 1)), 0.0]))
    return w


class Calibrated:
    """A view whose logits are calibrated."""

    def __init__(self, view, weights):
        self.view, self.weights = view, weights

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] * self.view.logit(x) + self.weights[1], -30, 30)


class CoTrained:
    """Two fitted views and their combination; given: (good, bad) pseudo-labels of each view as giver, a round after another."""

    def __init__(self, views, calibration, combined, given=()):
        self.views, self.calibration, self.combined, self.given = views, calibration, combined, list(given)

    def score(self, xs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: content view, metadata view, combined."""
        logits = [c[0] * v.logit(x) + c[1] for v, c, x in zip(self.views, self.calibration, xs)]
        both = np.c_[logits[0], logits[1], np.ones(len(logits[0]))] @ self.combined
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*logits, both))


def co_train(xs, y: np.ndarray, pick, rounds: int = ROUNDS) -> CoTrained | None:
    """Views fitted on labelled rows (every fourth kept for calibration) and on pseudo-labels they give one another; None without both classes.

    pick(views, share of good rows) returns for each view as giver what it is confident of: (features of both views, labels).
    """
    if len(y) < 8 or y.min() == y.max():
        return None
    hold = np.arange(len(y)) % 4 == 3
    if y[hold].min() == y[hold].max() or y[~hold].min() == y[~hold].max():
        hold = np.zeros(len(y), bool)
    calibrate = hold if hold.any() else ~hold
    own, labels, told = [[x[~hold]] for x in xs], [[y[~hold]], [y[~hold]]], []
    for k in range(rounds + 1):
        views = [Logistic().fit(np.concatenate(x), np.concatenate(t)) for x, t in zip(own, labels)]
        if k == rounds:
            break
        sure = [Calibrated(v, platt(v.logit(x[calibrate])[:, None], y[calibrate])) for v, x in zip(views, xs)]
        for giver, (features, given) in enumerate(pick(sure, float(y[~hold].mean()))):
            told.append((int(given.sum()), int(len(given) - given.sum())))
            own[1 - giver].append(features[1 - giver])
            labels[1 - giver].append(given)
    logits = [v.logit(x[calibrate]) for v, x in zip(views, xs)]
    calibration = [platt(z[:, None], y[calibrate]) for z in logits]
    scaled = np.stack([c[0] * z + c[1] for c, z in zip(calibration, logits)], axis=1)
    return CoTrained(views, calibration, platt(scaled, y[calibrate]), told)


_KINDS = "doc_id long, text string, source string, lang string, n_chars long"


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in _KINDS.split(", ")))


def _rows(batch: pa.RecordBatch):
    """(content, metadata) features of a batch of _KINDS."""
    xs = ([], [])
    for text, source, lang, n in zip(*(batch.column(k) for k in ("text", "source", "lang", "n_chars"))):
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        xs[0].append(content(data))
        xs[1].append(metadata(source.as_py(), lang.as_py(), n.as_py()))
    return [np.stack(x) for x in xs]


def _features_of(docs: DataFrame, chosen: DataFrame):
    """(doc_ids, both views' features, y) on the driver of the documents of chosen (doc_id, y), a bounded number; in an order of its own."""
    names = ["doc_id", "y", "c", "m"]

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                xs = _rows(part)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(5), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in xs)], names=names)

    rows = _slim(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "source", "lang", "n_chars", "y")
    made = rows.mapInArrow(lean(run), "doc_id long, y double, c binary, m binary")
    got = made.groupBy("doc_id").agg(F.min(F.struct("c", "m", "y")).alias("r")).select("doc_id", "r.y", "r.c", "r.m").toArrow()  # a row a chosen id
    order = np.argsort(got.column("doc_id").to_numpy())
    xs = [np.zeros((len(order), n), np.float32) for n in (PAIRS + 16, META)]
    for x, column in zip(xs, (got.column("c"), got.column("m"))):
        for k, i in enumerate(order.tolist()):
            x[k] = np.frombuffer(column[i].as_buffer(), np.float32)
    return got.column("doc_id").to_numpy()[order].tolist(), xs, got.column("y").to_numpy()[order].astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS, per_round: int = PER_ROUND, confident: float = CONFIDENT) -> CoTrained | None:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    y = scratch.keep(labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y")))
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = _slim(docs).select("doc_id").where("doc_id is not null").distinct()  # ids alone meet the labels: texts don't move
    _, xs, target = _features_of(docs, ids.join(y, "doc_id").orderBy(*order).limit(train_rows))
    xs, target, taken = [x[:train_rows] for x in xs], target[:train_rows], set()
    least = float(np.log(confident / (1 - confident)))

    def pick(views, good):
        sent = spark.sparkContext.broadcast(views)

        def run(batches):
            for b in batches:
                for k in range(0, b.num_rows, 512):
                    part = b.slice(k, 512)
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.round(v.logit(x), 9)) for v, x in zip(sent.value, _rows(part)))], names=["doc_id", "l0", "l1"])

        scored = _slim(docs).where("doc_id is not null").mapInArrow(lean(run), "doc_id long, l0 double, l1 double")
        scored = scratch.keep(scored.join(y, "doc_id", "left_anti").where((F.abs("l0") >= least) | (F.abs("l1") >= least)))
        n_good = int(round(per_round * good))
        for giver in range(2):
            at, chosen = F.col(f"l{giver}"), {}
            for label, n, sign in ((1.0, n_good, at), (0.0, per_round - n_good, -at)):
                # as many as could be taken before are asked for too, so that enough are left
                top = scored.where(sign >= least).orderBy(F.desc(sign), *order).limit(n + len(taken)).collect()
                own = [i for i in dict.fromkeys(r.doc_id for r in top) if i not in taken and i not in chosen][:n]
                chosen |= dict.fromkeys(own, label)
            taken.update(chosen)
            rows = spark.createDataFrame(list(chosen.items()), "doc_id long, y double")
            _, features, given = _features_of(docs, rows) if chosen else ([], [x[:0] for x in xs], np.zeros(0))
            yield features, given
        scratch.drop(scored)
        scratch.tidy()

    model = co_train(xs, target, pick, rounds)
    scratch.drop(y)
    del xs, target
    release()  # the driver goes on to other work
    return model


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """(doc_id, p_content, p_metadata, score) of docs (doc_id, text, source, lang, n_chars)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                ps = model.score(_rows(part)) if model else [np.ones(part.num_rows)] * 3
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.round(p, 9)) for p in ps)], names=["doc_id", "p_content", "p_metadata", "score"])

    return _slim(docs).mapInArrow(lean(run), "doc_id long, p_content double, p_metadata double, score double")


def keep_good(docs: DataFrame, model: CoTrained | None, least: float = KEEP_FROM) -> DataFrame:
    """The rows of docs, all columns, whose combined score is ``least`` or more; rows don't move."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in _KINDS.split(", ")]
    at = [next(i for i, c in enumerate(docs.columns) if c.lower() == n) for n in names]

    def run(batches):
        model = sent.value
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                if model:
                    own = pa.RecordBatch.from_arrays([part.column(i) for i in at], names=names)
                    part = part.filter(pa.array(model.score(_rows(own))[2] >= least))
                yield part

    return docs.mapInArrow(lean(run), docs.schema)


def op6_co_training(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("keep", F.col("score") >= KEEP_FROM)

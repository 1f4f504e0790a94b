"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts are enough: the non-negative unbiased
risk

    prior * R(positives, +) + max(0, R(unlabelled, -) - prior * R(positives, -))

is minimised by gradient descent over a small network on text statistics.  The
class prior is estimated from the same data: the smallest ratio of the shares of
unlabelled and positive texts above a threshold of a classifier that tells the
two samples apart.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neumatic.llm.common import discard, remainder, written
from neumatic.llm.quality_rules import Text

#: Texts of each kind, positive and unlabelled, that the model is fitted on at most.
SAMPLE_ROWS = 6000
FOLDS, HELD_OUT_FOLD = 3, 1
HIDDEN = 16
STEPS = 700


def statistics(raw: str | None) -> list[float]:
    """Numbers that describe a text's form; language and topic hardly show in them."""
    text = Text.of(raw)
    words, data = text.words, text.data
    n, size = max(len(words), 1), max(len(data), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    upper, lower = text.get("letters")
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = Counter(words)
    return [
        np.log1p(len(words)),
        text.get("word_chars") / n,
        float(lengths.std()),
        upper / max(upper + lower, 1),
        text.get("n_symbols") / n,
        text.get("n_bangs") / n,
        (size - len(data.translate(None, b"0123456789"))) / size,
        (size - len(data.translate(None, b".,;:"))) / n,
        (size - len(data.translate(None, b"!\"#$%&'()*+-/<=>?@[\\]^_`{|}~"))) / n,
        len(counts) / n,
        np.log1p(n) * len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        text.get("n_repeat_words") / n,
        text.get("n_dup_lines") / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / max(len(lines), 1),
        len(zlib.compress(data, 1)) / size if size > 200 else 0.5,
    ]


class Network:
    """One hidden layer; inputs are standardised and clipped."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def value(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3], h

    def slope(self, z: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        """Gradient of sum(g * value)."""
        back = np.outer(g, self.w[2]) * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]

    def fit(self, gradient, steps: int = STEPS, rate: float = 0.02, decay: float = 1e-3) -> None:
        """Adam; ``gradient()`` gives the slopes of the risk."""
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for t in range(1, steps + 1):
            step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, g in enumerate(gradient()):
                g = g + decay * self.w[k] * (k in (0, 2))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.value(self.inputs(x))[0], -30, 30)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling_apart(positive: np.ndarray, unlabelled: np.ndarray, base: Network) -> None:
    """Fit ``base`` to tell the two samples apart (logistic loss)."""
    zp, zu = base.inputs(positive), base.inputs(unlabelled)

    def gradient():
        (vp, hp), (vu, hu) = base.value(zp), base.value(zu)
        a = base.slope(zp, hp, (sigmoid(vp) - 1) / len(zp))
        return [x + y for x, y in zip(a, base.slope(zu, hu, sigmoid(vu) / len(zu)))]

    base.fit(gradient, 300)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: half of each sample trains, the other half is measured."""
    both = np.concatenate([positive, unlabelled])
    net = Network(both.mean(0), both.std(0) + 1e-6, seed=3)
    telling_apart(positive[::2], unlabelled[::2], net)
    p, u = np.sort(net.score(positive[1::2])), np.sort(net.score(unlabelled[1::2]))
    cuts = np.quantile(p, np.linspace(0, 0.9, 91))
    share_p = 1 - np.searchsorted(p, cuts, "left") / len(p)
    share_u = 1 - np.searchsorted(u, cuts, "left") / len(u)
    slack = 1.0 * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    best = int(np.argmin((share_u + slack) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Network:
    """The network of least non-negative risk."""
    prior = estimate_prior(positive, unlabelled) if prior is None else prior
    net = Network(unlabelled.mean(0), unlabelled.std(0) + 1e-6)
    zp, zu = net.inputs(positive), net.inputs(unlabelled)

    def gradient():
        (vp, hp), (vu, hu) = net.value(zp), net.value(zu)
        sp, su = sigmoid(vp), sigmoid(vu)  # the loss of value v is sigmoid(-v) for +, sigmoid(v) for -
        negative = su.mean() - prior * sp.mean()
        up = sp * (1 - sp) / len(zp)
        if negative < 0:  # step back from fitting the unlabelled as negatives
            a, b = net.slope(zp, hp, prior * up), net.slope(zu, hu, -su * (1 - su) / len(zu))
        else:
            a, b = net.slope(zp, hp, -2 * prior * up), net.slope(zu, hu, su * (1 - su) / len(zu))
        return [x + y for x, y in zip(a, b)]

    net.fit(gradient)
    return net


def described(texts: DataFrame) -> DataFrame:
    """(doc, positive, x): a key of the doc_id, and the statistics of each text."""
    def scan(batches):
        for batch in batches:
            x = [list(map(float, statistics(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc", "positive", "x"])

    return texts.select(F.xxhash64("doc_id").alias("doc"), "positive", "text").mapInArrow(scan, "doc long, positive boolean, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """Fit on training rows: texts that are labelled good, and any texts as unlabelled; None without either."""
    learn = remainder("doc_id", FOLDS) != HELD_OUT_FOLD
    good = labels.where(learn & (F.col("quality") == 1)).select("doc_id").distinct()
    ids = docs.where(learn).select("doc_id")
    order = F.xxhash64(F.lit("sample"), "doc_id")
    picked = good.orderBy(order, "doc_id").limit(sample_rows).select("doc_id", F.lit(True).alias("positive"))
    # the unlabelled sample is drawn without looking at the labels
    more = ids.orderBy(F.xxhash64(F.lit("unlabelled"), "doc_id"), "doc_id").limit(sample_rows).distinct().select("doc_id", F.lit(False).alias("positive"))
    found = written(described(docs.join(F.broadcast(picked.unionByName(more)), "doc_id")), "sample")
    # a row a doc_id and kind, whatever repeats: at most 2 * sample_rows
    sample = found.groupBy("doc", "positive").agg(F.min("x").alias("x")).orderBy("x", "positive").collect()
    discard(found)
    positive = np.array([r.x for r in sample if r.positive])
    unlabelled = np.array([r.x for r in sample if not r.positive])
    return fit(positive, unlabelled) if len(positive) > 20 and len(unlabelled) > 20 else None


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Scores come from whole texts alone.  Null and empty texts have the
    statistics of an empty text; repeated rows are scored each; other columns
    are ignored; an empty table gives an empty result.  With 20 training texts
    or fewer of either kind every score is 0.5.  Rows that share a doc_id count
    once in the sample.  Memory: a batch of texts, and the words and windows of
    one text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))  # a few hundred weights
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def scan(batches):
        net = shared.value
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(2).to_pylist()], float).reshape(batch.num_rows, -1)
            score = net.score(x) if net is not None and len(x) else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    rows = docs.select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT_FOLD).alias("held_out"), "text")
    return rows.mapInArrow(scan, schema)

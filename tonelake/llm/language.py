"""Language identification with a byte convolutional network in numpy.

Filters of width 2, 3 and 4 slide over the UTF-8 bytes of a fixed-length
window; each filter's largest response in the window feeds a softmax.  A text
is cut into windows, all of them are classified in batches, and the mean of
their log-probabilities, weighted by the bytes in each, decides.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_of

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: The training sample: so many texts of each language, of all languages together (one of each at least), and windows of each text at most.
SAMPLE_DOCS = 400
SAMPLE_ALL = 40_000
SAMPLE_WINDOWS = 3
#: Slots by hash, of which each gives its least hash to the sample.
SLOTS = 2048
UNKNOWN = "und"
BATCH_BYTES = 4 << 20


def windows_of(data: bytes) -> np.ndarray:
    """``(n, WINDOW)`` bytes; the last window is filled up with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class Net:
    """``tables[w][j]`` holds what byte value b at offset j adds to each filter."""

    def __init__(self, n_classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = {w: [rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), n_classes)).astype(np.float32)
        self.out_bias = np.zeros(n_classes, np.float32)

    def params(self) -> list[np.ndarray]:
        return [t for w in WIDTHS for t in self.tables[w]] + [self.bias, self.out, self.out_bias]

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 96, rate: float = 0.02, seed: int = 11) -> None:
        """Adam on the cross entropy; gradients reach each filter's largest place only."""
        rng = np.random.default_rng(seed)
        params = self.params()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        weight = 1.0 / np.bincount(y, minlength=self.out.shape[1]).clip(1)
        chance = weight[y] / weight[y].sum()
        for step in range(1, steps + 1):
            pick = rng.choice(len(x), batch, p=chance)
            xb, yb, rows = x[pick], y[pick], np.arange(batch)
            pooled, places = [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                r = self.tables[w][0][xb[:, :n]]
                for j in range(1, w):
                    r = r + self.tables[w][j][xb[:, j : j + n]]
                at = r.argmax(1)
                places.append(at)
                pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
            z = np.tanh(np.hstack(pooled) + self.bias)
            logits = z @ self.out + self.out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[rows, yb] -= 1
            p /= batch
            dz = (p @ self.out.T) * (1 - z * z)
            grads = []
            for i, w in enumerate(WIDTHS):
                d = dz[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    g = np.zeros((256, FILTERS), np.float32)
                    for f in range(FILTERS):
                        g[:, f] = np.bincount(xb[rows, places[i][:, f] + j], d[:, f], 256)
                    grads.append(g)
            grads += [dz.sum(0), z.T @ p, p.sum(0)]
            for k, (v, g) in enumerate(zip(params, grads)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                v -= (rate * (1 - 0.8 * step / steps) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def freeze(self) -> dict:
        """Tables by byte pair, so that a window takes five look-ups a place."""
        t = self.tables
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        return {"p2": pair(*t[2]), "p3": pair(t[3][0], t[3][1]), "s3": t[3][2], "p4": pair(t[4][0], t[4][1]), "q4": pair(t[4][2], t[4][3]), "bias": self.bias, "out": self.out, "out_bias": self.out_bias}


def log_probs(net: dict, x: np.ndarray) -> np.ndarray:
    """``(windows, classes)`` log-probabilities."""
    parts = []
    for start in range(0, len(x), 64):
        b = x[start : start + 64]
        pair = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
        a = net["p2"].take(pair, 0).max(1)
        c = net["p3"].take(pair[:, :-1], 0)
        c += net["s3"].take(b[:, 2:], 0)
        d = net["p4"].take(pair[:, :-2], 0)
        d += net["q4"].take(pair[:, 2:], 0)
        parts.append(np.hstack([a, c.max(1), d.max(1)]))
    z = np.tanh(np.vstack(parts) + net["bias"])
    logits = z @ net["out"] + net["out_bias"]
    top = logits.max(1, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(1, keepdims=True))


def fit(labelled: DataFrame) -> tuple[list[str], dict | None]:
    """Train on ``(doc_id, text, lang)``: languages in order, frozen network.

    Rows without text or language are not used; every language of the others
    is learned.  The hashes of id and text are dealt into ``SLOTS`` slots a
    language; of each slot's least hash those are taken that are least when
    hashed once more, ``SAMPLE_DOCS`` a language at most, so the sample's size
    does not depend on the input's.  Equal rows have one hash and count once,
    however many there are; other columns do not matter; a table without
    labelled texts, as an empty one, gives ``([], None)``.
    """
    rows = labelled.where("text is not null and lang is not null and text <> ''").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    least = rows.groupBy("lang", F.pmod("h", F.lit(SLOTS)).alias("slot")).agg(F.min("h").alias("h"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h")
    ranked = materialize(least.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_DOCS).select("lang", "h", "r"), "language-sample")
    langs = sorted(r["lang"] for r in ranked.select("lang").distinct().collect())
    if not langs:
        return [], None
    spread = F.greatest(F.length("text") - F.lit(WINDOW), F.lit(0))
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: (i * spread / F.lit(max(1, SAMPLE_WINDOWS - 1))).cast("int")))
    taken = F.transform(cuts, lambda at: F.substring(F.col("text"), at + 1, F.lit(WINDOW)))
    # At most SAMPLE_ALL hashes, or one a language, are broadcast.
    picked = ranked.where(F.col("r") <= max(1, SAMPLE_ALL // len(langs))).select("lang", "h")
    got = rows.join(F.broadcast(picked), ["lang", "h"], "left_semi").select("lang", "h", taken.alias("cuts")).dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect()
    known = {lang: i for i, lang in enumerate(langs)}
    x, y = [], []
    for r in got:
        for cut in r["cuts"]:
            x.append(windows_of(cut.encode("utf-8", "replace")[:WINDOW])[0])
            y.append(known[r["lang"]])
    net = Net(len(langs))
    net.train(np.stack(x), np.array(y))
    return langs, net.freeze()


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def predict(docs: DataFrame, langs: list[str], net: dict | None, keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (or other ``names``) of every whole text.

    A null text and one without letters is ``und`` with score 0, as is every
    text where nothing was labelled.  Other texts get the most probable
    learned language and its share of the geometric mean of their windows'
    probabilities.  Repeated rows are judged each for itself and alike, ids are
    not looked at, a very long text is judged by all its windows, an empty
    table gives no rows, and columns not in ``keep`` are left out.  Only texts
    go to Python: kept columns of whatever type stay as they are.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b.to_list()
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            start = 0
            while net is not None and start < len(texts):
                xs, owner, size, stop = [], [], 0, start
                while stop < len(texts) and (size < BATCH_BYTES or stop == start):
                    if texts[stop]:
                        data = texts[stop].encode("utf-8", "replace")
                        xs.append(windows_of(data))
                        owner.append(stop)
                        size += len(data)
                    stop += 1
                if xs:
                    counts = np.array([len(a) for a in xs])
                    x = np.concatenate(xs)
                    lp = log_probs(net, x)
                    lp *= (x != 0).sum(1, keepdims=True)
                    weight = (x != 0).sum(1)
                    ends = np.r_[0, np.cumsum(counts)[:-1]]
                    mean = np.add.reduceat(lp, ends) / np.maximum(1, np.add.reduceat(weight, ends))[:, None]
                    p = np.exp(mean - mean.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                    for i, row in enumerate(owner):
                        pred[row], score[row] = langs[best[i]], float(p[i, best[i]])
                start = stop
            yield pd.DataFrame({"lang": pred, "score": score})

    # Not deterministic only for the optimizer, which then runs it once a row and not once a use.
    judge = F.pandas_udf(run, T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])).asNondeterministic()
    judged = f"_judged_{uuid.uuid4().hex}"
    rows = docs.withColumn(judged, judge(F.when(has_letter(text_of()), F.col("text"))))
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.col(judged)["lang"].alias(names[0]), F.col(judged)["score"].alias(names[1]))

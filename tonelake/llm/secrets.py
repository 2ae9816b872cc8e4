"""Secret scans: rules, and a character convolutional network over every other candidate.

A first pass over whole texts lists the places the rules find and all
candidates: runs of token characters that mix kinds of characters, and values
that are assigned to a name.  Candidates that a rule found are labelled as
findings; others as none where they read as words and numbers.  What looks drawn
at random though no rule found it has no label: the network decides.  Every
distinct labelled value counts: one in four is for calibration, from all others
the network learns.  They are dealt into parts, each part's task carries the
network on over its own values, and the networks are averaged, round by round.
Findings are also shown to it with other surroundings and with their characters
drawn anew, so that it judges by the look of a value and not by the rules' words
alone.  Scores are calibrated on all values it did not learn from, and each form
of candidate has the highest threshold that keeps the recall asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_of

# The rules, and the least length of what they find.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS = 6

KINDS = ("assign", "access", "hex", "net")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: A name, a sign and a value that is not named by the rules.
VALUE = re.compile(r"""[A-Za-z0-9_]["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.-][A-Za-z0-9+/_.=-]{5,})""")
#: What is no secret, of which every text gives an example each.
PLAIN = (re.compile(r"[A-Za-z]{6,}"), re.compile(r"[0-9][0-9.-]{5,}"))
#: A value with more than one change of kind (lower, upper, digit) in so many characters looks drawn at random.
CHANGE = 6
BARE, ASSIGNED, ORDINARY = 0, 1, 2
#: Characters before and after a candidate that the network sees.
BEFORE, AFTER = 24, 8
WIDTHS, FILTERS = (2, 4), 12
#: The network reads rows in pieces of so many characters, so many pieces at once.
PIECE, PIECES = 128, 1024
#: Values are dealt into parts of about so many bytes; each has about so many of the rarer label too, or all of them.
PART_BYTES, LEAST = 1 << 20, 512
#: Rounds after which the parts' networks are averaged, so many at once; steps of each part in all rounds at least; rows and pieces of a label in a step.
ROUNDS, NETS, STEPS, STEP_ROWS, STEP_PIECES = 4, 32, 300, 32, 128
#: Cells into which the scores between two bounds are counted.
CELLS = 1024
#: Of the labelled findings that calibration sees, at least this share scores above the threshold.
RECALL = 0.98
#: Values whose hash has this remainder by four are for calibration.
HELD = 2
BLOCK = 1 << 15
BATCH_CHARS = 4 << 20
_WIDE = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
_INSIDE = 128


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by start, then kind: what the rules find, leftmost and not overlapping in each kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_CHARS]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)] + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _mixed(value: str) -> bool:
    kinds = any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value)
    return kinds > 1 and (any(c.isdigit() for c in value) or not value[:1].isupper() or not value[1:].islower())


def random_looking(value: str) -> bool:
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "" for c in value]
    return CHANGE * sum(a != b and bool(a and b) for a, b in zip(kinds, kinds[1:])) > len(value)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, form)`` of all candidates, ascending, none inside another."""
    found = [(m.start(1), m.end(1), ASSIGNED) for m in VALUE.finditer(text) if _mixed(m[1])]
    taken = {b for _, b, _ in found}
    found += [(m.start(), m.end(), BARE) for m in RUN.finditer(text) if m.end() not in taken and _mixed(m[0])]
    return sorted(found)


def codes(text: str, start: int, end: int) -> np.ndarray:
    """What the network sees: one number below 256 a character, those of the candidate marked."""
    left = max(0, start - BEFORE)
    points = np.frombuffer(text[left : end + AFTER].encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(points < 127, np.maximum(points, 1), 127).astype(np.uint8)
    out[start - left : end - left] |= _INSIDE
    return out


def pieces(code: np.ndarray) -> np.ndarray:
    """``(n, PIECE)`` codes of the whole row between edges of zeros; pieces overlap, so that no place is lost."""
    edge = max(WIDTHS)
    step = PIECE - edge + 1
    n = -(-(len(code) + edge + 1) // step)
    row = np.pad(code, (edge, n * step - 1 - len(code)))
    return np.lib.stride_tricks.sliding_window_view(row, PIECE)[::step]


def steps_of(order: np.ndarray, cut: list[np.ndarray]) -> list[np.ndarray]:
    """All rows in their order, by the step that learns from them: at most about ``STEP_ROWS`` rows and ``STEP_PIECES`` pieces, one row at least."""
    if not len(order):
        return []
    share = np.array([max(1 / STEP_ROWS, len(cut[i]) / STEP_PIECES) for i in order])
    step = np.floor((np.cumsum(share) - share / 2) * np.ceil(share.sum()) / share.sum())
    return np.split(order, np.flatnonzero(np.diff(step)) + 1)


class Net:
    """Filters slide over the characters; each one's largest response feeds a logistic unit."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.tables = {w: [rng.normal(0, 0.2, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.4, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [t for w in WIDTHS for t in self.tables[w]] + [self.bias, self.out, self.out_bias]

    def forward(self, x: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Logits, pooled responses and their places (piece, offset) of rows of equal length, or of rows cut into such pieces, each row's first at ``starts``."""
        pooled, places = [], []
        for w in WIDTHS:
            n, top, at = x.shape[1] - w + 1, [], []
            for some in range(0, len(x), PIECES):
                r = sum(self.tables[w][j][x[some : some + PIECES, j : j + n]] for j in range(w))
                at.append(r.argmax(1))
                top.append(np.take_along_axis(r, at[-1][:, None], 1)[:, 0])
            top, at = np.concatenate(top), np.concatenate(at)
            piece = np.repeat(np.arange(len(x))[:, None], FILTERS, 1)
            if starts is not None and len(starts) < len(x):
                most = np.maximum.reduceat(top, starts)
                reached = top == np.repeat(most, np.diff(np.r_[starts, len(x)]), 0)
                piece = np.minimum.reduceat(np.where(reached, piece, len(x)), starts)
            pooled.append(np.take_along_axis(top, piece, 0))
            places.append((piece, np.take_along_axis(at, piece, 0)))
        z = np.tanh(np.hstack(pooled) + self.bias)
        return z @ self.out + self.out_bias[0], z, places

    def gradients(self, x: np.ndarray, y: np.ndarray, starts: np.ndarray | None = None, weight: np.ndarray | None = None) -> list[np.ndarray]:
        """Of the mean cross entropy, or that with the rows' weights, in the order of :meth:`params`."""
        logits, z, places = self.forward(x, starts)
        miss = ((1 / (1 + np.exp(-np.clip(logits, -60, 60))) - y) * (1 / len(y) if weight is None else weight)).astype(np.float32)
        dz, grads = np.outer(miss, self.out) * (1 - z * z), []
        for i, w in enumerate(WIDTHS):
            d, (piece, at) = dz[:, i * FILTERS : (i + 1) * FILTERS], places[i]
            for j in range(w):
                g = np.zeros((256, FILTERS), np.float32)
                for f in range(FILTERS):
                    g[:, f] = np.bincount(x[piece[:, f], at[:, f] + j], d[:, f], 256)
                grads.append(g)
        return [*grads, dz.sum(0), z.T @ miss, miss.sum(keepdims=True)]

    def train(self, rows: list[np.ndarray], y: np.ndarray, begin: float = 0.0, end: float = 1.0, rate: float = 0.02, seed: int = 5) -> None:
        """Adam on the way from ``begin`` to ``end`` of 0 to 1, on which every row is learned from at least once; both labels weigh the same."""
        rng, params, cut = np.random.default_rng(seed), self.params(), [pieces(r) for r in rows]
        sides = [steps_of(rng.permutation(np.flatnonzero(y == side)), cut) for side in (0, 1)]
        total = max(STEPS, *map(len, sides))
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for n, step in enumerate(range(round(total * begin), round(total * end)), 1):
            picks = [side[step % len(side)] for side in sides if side]
            pick, weight = np.concatenate(picks), np.concatenate([np.full(len(k), 1 / len(k) / len(picks)) for k in picks])
            x, starts = np.concatenate([cut[i] for i in pick]), np.cumsum([0, *[len(cut[i]) for i in pick[:-1]]])
            for k, (p, g) in enumerate(zip(params, self.gradients(x, y[pick], starts, weight))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p -= (rate * (1 - 0.8 * (step + 1) / total) * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params()]).astype(np.float64)

    def put(self, flat: np.ndarray) -> None:
        for p, values in zip(self.params(), np.split(flat, np.cumsum([p.size for p in self.params()])[:-1])):
            p[...] = values.reshape(p.shape)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Logits of rows of any lengths: the largest responses of a long one are taken block by block."""
        out = np.zeros(len(rows))
        widest = max(WIDTHS)
        for at, row in enumerate(rows):
            row = np.pad(row, (widest, widest))
            pooled = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32)
            for start in range(0, len(row) - widest + 1, BLOCK):
                part = row[start : start + BLOCK + widest - 1]
                here = [sum(self.tables[w][j][part[j : len(part) - w + 1 + j]] for j in range(w)).max(0) for w in WIDTHS]
                pooled = np.maximum(pooled, np.concatenate(here))
            out[at] = np.tanh(pooled + self.bias) @ self.out + self.out_bias[0]
        return out


class Model:
    """A network, its calibration and a threshold for each form of candidate."""

    def __init__(self, net: Net, slope: float, offset: float, thresholds: dict[int, float]):
        self.net, self.slope, self.offset, self.thresholds = net, slope, offset, thresholds

    def of_logits(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -60, 60)))

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.of_logits(self.net.score(rows))


def listed(docs: DataFrame) -> DataFrame:
    """``(doc_id, base array<struct<start, end, kind>>, found array<struct<start, end, form, label, seen>>)`` of each row.

    ``found`` are the candidates, ``label`` whether a rule found them (null
    where that is not known), ``seen`` what the network sees, and an ordinary
    word and number of the text (form 2), at a place that depends on the text,
    as examples of what is no secret.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        seen = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("form", pa.int32()), ("label", pa.bool_()), ("seen", pa.binary())]))
        for b in batches:
            ids, texts, begin = b.column(0), b.column(1), 0
            while begin < len(b):
                spans, found, size, stop = [], [], 0, begin
                while stop < len(b) and (size < BATCH_CHARS or stop == begin):
                    text = texts[stop].as_py()
                    base, rows, at = base_spans(text), [], 0
                    ends: list[int] = []  # of rules' places, each the furthest so far
                    for _, e, _ in base:
                        ends.append(max(e, ends[-1] if ends else 0))
                    for a, e, form in candidates(text):
                        while at < len(base) and base[at][0] < e:
                            at += 1
                        rows.append({"start": a, "end": e, "form": form, "label": True if at and ends[at - 1] > a else None if random_looking(text[a:e]) else False, "seen": codes(text, a, e).tobytes()})
                        size += e - a + BEFORE + AFTER
                    place = zlib.crc32(text[:4096].encode("utf-8", "replace")) % (len(text) + 1)
                    for example in filter(None, (x.search(text, place) or x.search(text) for x in PLAIN)):
                        if not any(r["start"] < example.end() and example.start() < r["end"] for r in rows):
                            rows.append({"start": example.start(), "end": example.end(), "form": ORDINARY, "label": False, "seen": codes(text, *example.span()).tobytes()})
                    spans.append([{"start": a, "end": e, "kind": k} for a, e, k in base])
                    found.append(rows)
                    size += len(text)
                    stop += 1
                yield pa.RecordBatch.from_arrays([ids.slice(begin, stop - begin), pa.array(spans, span), pa.array(found, seen)], names=["doc_id", "base", "found"])
                begin = stop

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"))
    return rows.mapInArrow(run, "doc_id long, base array<struct<start:long,end:long,kind:string>>, found array<struct<start:long,end:long,form:int,label:boolean,seen:binary>>")


def _redrawn(code: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The candidate's letters and digits drawn anew from letters of both cases and digits."""
    out = code.copy()
    at = np.flatnonzero((code >= _INSIDE) & np.isin(code & 127, _WIDE))
    out[at] = rng.choice(_WIDE, len(at)) | _INSIDE
    return out


def _moved(code: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The candidate of one row in the surroundings of another."""
    inside = lambda c: np.flatnonzero(c >= _INSIDE)
    a, b = inside(code), inside(other)
    return np.r_[other[: b[0]], code[a[0] : a[-1] + 1], other[b[-1] + 1 :]]


def labelled(found: DataFrame) -> DataFrame:
    """``(label, seen, form, h, held)``: every distinct labelled value of ``found (doc_id, base, found)``; ``held`` ones are for calibration."""
    rows = found.select(F.explode("found").alias("c")).select("c.label", "c.form", "c.seen").where("label is not null")
    rows = rows.groupBy("label", "seen").agg(F.min("form").alias("form")).withColumn("h", F.xxhash64("seen"))
    return rows.withColumn("held", F.pmod("h", F.lit(4)) == HELD)


def dealt(values: DataFrame, sizes: dict[bool, tuple[int, int]]) -> tuple[DataFrame, int]:
    """``values`` with ``part`` and ``copy``, and the number of parts; ``sizes`` has number and bytes of each label's values.

    Parts hold about ``PART_BYTES`` at any size of the input.  Each value lies
    in a part by hash as copy 0; where a label is rare its values lie in the
    next parts too, as further copies, so that every part knows both labels.
    """
    parts = max(1, -(-sum(b for _, b in sizes.values()) // PART_BYTES))
    copies = {k: min(parts, max(1, -(-parts * min(LEAST, max(1, PART_BYTES * n // b)) // n))) if n else 1 for k, (n, b) in sizes.items()}
    rows = values.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("label"), copies[True] - 1).otherwise(copies[False] - 1))))
    return rows.withColumn("part", F.pmod(F.pmod(F.xxhash64("h"), F.lit(parts)) + F.col("copy"), F.lit(parts)).cast("int")), parts


def shown(p: pd.DataFrame, part: int) -> Iterator[tuple[np.ndarray, bool, int, int]]:
    """``(codes, label, form, copy)`` of a part's values, the same for any order of them; findings also elsewhere and with characters drawn anew."""
    rows = sorted(zip(p["label"].tolist(), p["h"].tolist(), p["seen"].tolist(), p["form"].tolist(), p["copy"].tolist()))
    rng, code = np.random.default_rng([9, part]), [np.frombuffer(r[2], np.uint8) for r in rows]
    no = [c for c, r in zip(code, rows) if not r[0]]
    for c, (label, _, _, form, copy) in zip(code, rows):
        yield c, label, form, copy
        if label:
            there = no[rng.integers(len(no))] if no else c
            yield _moved(c, there), label, BARE, copy
            yield _redrawn(c, rng), label, form, copy
            yield _moved(_redrawn(c, rng), there), label, BARE, copy


def learned(rows: DataFrame, parts: int) -> Net:
    """A network that has learned from all values of ``rows``, dealt as by :func:`dealt`.

    In each round every part's task carries the network on; the results are
    averaged ``NETS`` at a time until one is left, each with the weight of its values.
    """
    net = Net()

    def carried_on(before: np.ndarray, turn: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            here = Net()
            here.put(before)
            code, label, _, _ = zip(*shown(p, key[0]))
            here.train(list(code), np.array(label, np.float32), turn / ROUNDS, (turn + 1) / ROUNDS)
            return pd.DataFrame({"part": [key[0]], "n": [len(p)], "net": [here.flat().tobytes()]})

        return run

    def merged(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("part")
        mean = sum(n * np.frombuffer(data) for n, data in zip(p["n"], p["net"])) / p["n"].sum()
        return pd.DataFrame({"part": [key[0]], "n": [p["n"].sum()], "net": [mean.tobytes()]})

    for turn in range(ROUNDS):
        nets = materialize(rows.repartition(parts, "part").groupBy("part").applyInPandas(carried_on(net.flat(), turn), "part int, n long, net binary"), "secret-nets")
        left = parts
        while left > 1:
            fewer = materialize(nets.groupBy(F.expr(f"cast(part div {NETS} as int)").alias("part_of")).applyInPandas(merged, "part int, n long, net binary"), "secret-nets")
            discard(nets)
            nets, left = fewer, -(-left // NETS)
        net.put(np.frombuffer(bytes(nets.first()["net"])))
        discard(nets)
    return net


def fit(found: DataFrame, recall: float = RECALL) -> Model | None:
    """Train on the candidates of ``found (doc_id, base, found)``; nothing where either label is missing.

    All distinct labelled values take part, however often one occurs: most are
    learned from, those of a fourth of the hashes are scored, and calibration
    and thresholds are of all of these scores.
    """
    values = materialize(labelled(found), "secret-values")
    size = F.greatest(F.length("seen"), F.lit(PIECE)).cast("long")
    sizes = {(r["label"], r["held"]): (r["n"], r["b"]) for r in values.groupBy("label", "held").agg(F.count("*").alias("n"), F.sum(size).alias("b")).collect()}
    of = lambda out: {label: sizes.get((label, out), (0, 0)) for label in (True, False)}
    if not all(n for n, _ in of(False).values()):
        discard(values)
        return None
    net = learned(*dealt(values.where("not held"), of(False)))
    # Few labels leave nothing to calibrate on: then those that were learned from serve.
    out = all(n > 4 for n, _ in of(True).values())
    rows, parts = dealt(values.where(F.col("held") == out), of(out))

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        code, label, form = zip(*[x[:3] for x in shown(p, key[0]) if not x[3]]) if (p["copy"] == 0).any() else ((), (), ())
        return pd.DataFrame({"logit": net.score(list(code)), "label": np.array(label, bool), "form": np.array(form, np.int32)})

    scores = materialize(rows.repartition(parts, "part").groupBy("part").applyInPandas(run, "logit double, label boolean, form int"), "secret-scores")
    slope, offset = calibrated(scores)
    model = Model(net, slope, offset, {})
    yes = scores.where("label").withColumn("x", F.col("logit") * (1.0 if slope >= 0 else -1.0))
    counts = {r["form"]: r["n"] for r in yes.groupBy("form").agg(F.count("*").alias("n")).collect()}
    for form in (BARE, ASSIGNED):
        n, some = (counts[form], yes.where(F.col("form") == form)) if form in counts else (sum(counts.values()), yes)
        model.thresholds[form] = float(model.of_logits(kth_largest(some, kept(n, recall)) * (1.0 if slope >= 0 else -1.0)))
    discard(scores)
    discard(values)
    return model


def calibrated(scores: DataFrame, steps: int = 60) -> tuple[float, float]:
    """Slope and offset that make the logits of all ``scores (logit, label)`` log odds.

    Newton's steps on the cross entropy, with smoothed labels and both labels of
    equal weight; each pass over the table tries a step in eight lengths.
    """
    n = {r["label"]: r["n"] for r in scores.groupBy("label").agg(F.count("*").alias("n")).collect()}
    yes, no = max(1, n.get(True, 0)), max(1, n.get(False, 0))
    by_label = lambda a, b: F.when(F.col("label"), F.lit(a)).otherwise(F.lit(b))
    weight, aim, x = by_label(0.5 / yes, 0.5 / no), by_label((yes + 1) / (yes + 2), 1 / (no + 2)), F.col("logit")

    def sums(w: np.ndarray) -> list[Column]:
        """Loss, gradient and curvature at ``w``."""
        z = x * float(w[0]) + float(w[1])
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0))))
        loss, miss, bend = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - aim * z, p - aim, p * (1 - p)
        return [F.sum(weight * v) for v in (loss, miss * x, miss, bend * x * x, bend * x, bend)]

    w, rate = np.array([1.0, 0.0]), 1.0
    here = scores.agg(*[v.alias(str(i)) for i, v in enumerate(sums(w))]).first()
    for _ in range(steps):
        move = np.linalg.solve(np.array([[here[3], here[4]], [here[4], here[5]]]) + 1e-9 * np.eye(2), np.array(here[1:3]))
        tried = [w - rate / 2**i * move for i in range(8)]
        seen = scores.agg(*[v.alias(f"{i}_{j}") for i, t in enumerate(tried) for j, v in enumerate(sums(t))]).first()
        found = [(t, seen[6 * i : 6 * i + 6]) for i, t in enumerate(tried) if seen[6 * i] < here[0]]
        if found:
            gain, rate = here[0] - found[0][1][0], 1.0
            w, here = found[0]
            if gain <= 1e-12 * abs(here[0]):
                break
        elif rate > 1e-6:
            rate /= 2**8
        else:
            break
    return float(w[0]), float(w[1])


def kth_largest(rows: DataFrame, k: int) -> float:
    """The ``k``-th largest of all ``x``, counted from 1: cells between two bounds are counted, then those within the cell it lies in, until one value is left."""
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    while low < high:
        cell = F.least(F.floor((F.col("x") - low) / (high - low) * CELLS), F.lit(CELLS - 1))
        inside = rows.where(F.col("x").between(low, high)).groupBy(cell.alias("cell"))
        for r in inside.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy(F.desc("cell")).collect():
            if k <= r["n"]:
                break
            k -= r["n"]
        low, high = r["low"], r["high"]
    return low


def kept(n: int, recall: float) -> int:
    """How many of ``n`` make up at least ``recall``, one at least."""
    return max(1, int(np.ceil(recall * n)))


def threshold(p: np.ndarray, recall: float) -> float:
    """The highest value that at least ``recall`` of ``p`` reach."""
    return float(np.sort(p)[::-1][kept(len(p), recall) - 1])


def scan(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """``(doc_id, base, spans)`` of whole texts, one row per row of ``docs``.

    ``base`` and ``spans`` are arrays of ``(start, end, kind)`` in code points,
    by start and kind; ``spans`` adds to ``base`` the candidates the network
    takes for secrets (kind ``net``), never one that a rule's place overlaps.
    A null text is empty; without findings or without other candidates
    nothing can be learned and ``spans`` is ``base``; repeated rows are scanned
    each for itself and alike; very long texts and candidates are read whole;
    an empty table gives no rows; other columns are not read.
    """
    found = materialize(listed(docs), "secret-candidates")
    model = fit(found, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in batches:
            added = []
            for item in b.column(2):
                rows = [c for c in item if not c["label"].as_py() and c["form"].as_py() != ORDINARY] if model else []
                p = model.probability([np.frombuffer(c["seen"].as_py(), np.uint8) for c in rows]) if rows else ()
                added.append([{"start": c["start"].as_py(), "end": c["end"].as_py(), "kind": KINDS[3]} for c, v in zip(rows, p) if v >= model.thresholds[c["form"].as_py()]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(added, span)], names=["doc_id", "base", "added"])

    spans = "array<struct<start:long,end:long,kind:string>>"
    rows = found.mapInArrow(run, f"doc_id long, base {spans}, added {spans}")
    # Kinds are in the order of KINDS: three of the rules, then the network's, which never starts where a rule's does.
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind"))
    both = F.transform(F.array_sort(F.transform(F.concat("base", "added"), place)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.select("doc_id", "base", both.alias("spans"))

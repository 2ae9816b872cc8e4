"""The network, its calibration and its thresholds come from every labelled value, whatever their number and length."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.llm import secrets

WIDE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def labelled_values(seed, findings, others):
    """``(label, form, seen)``: keys drawn at random and words."""
    rng, rows = random.Random(seed), []
    draw = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    for i in range(findings + others):
        before, after = draw("aeiou nrst", 30) + " ", " " + draw("aeiou nrst", 20)
        value = draw(WIDE, rng.randint(20, 40)) if i < findings else draw("abcdefghijklmnopqrst", rng.randint(6, 12))
        rows.append((i < findings, secrets.BARE if i < findings else secrets.ORDINARY, secrets.codes(before + value + after, len(before), len(before) + len(value)).tobytes()))
    return rows


def found(spark, rows):
    return spark.createDataFrame([(i, [r]) for i, r in enumerate(rows)], "doc_id long, found array<struct<label:boolean,form:int,seen:binary>>")


def told(model):
    return [*(p.tobytes() for p in model.net.params()), model.slope, model.offset, *model.thresholds.values()]


def test_each_of_many_values_counts(spark):
    rows = labelled_values(1, 300, 5000)
    whole = told(secrets.fit(found(spark, rows)))
    assert told(secrets.fit(found(spark, rows + rows[:7]).repartition(3))) == whole
    # One to learn from and one for calibration; a sample by the least hash of each slot had neither.
    for left_out in (301, 305):
        assert told(secrets.fit(found(spark, [r for i, r in enumerate(rows) if i != left_out]))) != whole


def test_values_are_dealt_whole_and_every_part_knows_both_labels(spark, monkeypatch):
    monkeypatch.setattr(secrets, "PART_BYTES", 1 << 15)
    monkeypatch.setattr(secrets, "LEAST", 16)
    for findings, others in ((40, 3000), (3, 1500), (1500, 2)):
        values = secrets.labelled(found(spark, labelled_values(2, findings, others)))
        sizes = {r["label"]: (r["n"], r["n"] * secrets.PIECE) for r in values.groupBy("label").agg(F.count("*").alias("n")).collect()}
        rows, parts = secrets.dealt(values, sizes)
        rows = rows.collect()
        first = [(r["label"], bytes(r["seen"])) for r in rows if not r["copy"]]
        assert sorted(first) == sorted((a, c) for a, _, c in labelled_values(2, findings, others)) and parts > 4
        assert {(r["label"], r["part"]) for r in rows} == {(label, k) for label in (True, False) for k in range(parts)}
        assert len({(r["seen"], r["part"]) for r in rows}) == len(rows)
        assert len(rows) - len(first) <= secrets.LEAST * parts + min(findings, others)


def test_networks_of_many_parts_are_averaged_into_one_that_tells(spark, monkeypatch):
    monkeypatch.setattr(secrets, "PART_BYTES", 1 << 15)
    monkeypatch.setattr(secrets, "NETS", 2)
    model = secrets.fit(found(spark, labelled_values(3, 300, 1500)))
    rows = labelled_values(4, 200, 200)
    over = model.probability([np.frombuffer(s, np.uint8) for _, _, s in rows]) >= model.thresholds[secrets.BARE]
    label = np.array([r[0] for r in rows])
    assert over[label].mean() > 0.9 and over[~label].mean() < 0.02


def test_every_row_has_its_step():
    cut = [np.zeros((n, secrets.PIECE)) for n in [1] * 100 + [700, 3, 2000, 1, 90, 600]]
    for order in (np.arange(len(cut)), np.random.default_rng(1).permutation(len(cut)), np.arange(3), np.array([100])):
        steps = secrets.steps_of(order, cut)
        assert np.concatenate(steps).tolist() == order.tolist() and all(len(s) for s in steps)
        assert all(len(s) <= 2 * secrets.STEP_ROWS for s in steps)
        assert all(sum(len(cut[i]) for i in s) <= 2 * secrets.STEP_PIECES + max(len(cut[i]) for i in s) for s in steps)
    assert secrets.steps_of(np.arange(0), cut) == []


def test_long_values_are_learned_from_whole(monkeypatch):
    monkeypatch.setattr(secrets, "PIECES", 7)
    rng, net = np.random.default_rng(6), secrets.Net(seed=2)
    rows = [rng.integers(1, 256, n).astype(np.uint8) for n in (1, 40, 119, 120, 121, 5000, 244, 245, 1000)]
    cut = [secrets.pieces(r) for r in rows]
    starts = np.cumsum([0, *map(len, cut[:-1])])
    x, y, weight = np.concatenate(cut), np.arange(len(rows)) % 2, rng.random(len(rows))
    assert net.forward(x, starts)[0] == pytest.approx(net.score(rows), abs=1e-5)

    def loss():
        z = net.forward(x, starts)[0].astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    for p, g in zip(net.params(), net.gradients(x, y, starts, weight)):
        at = np.unravel_index(int(np.abs(g).argmax()), p.shape)
        keep, step = p[at], np.float32(1e-3)
        p[at] = keep + step
        up = loss()
        p[at] = keep - step
        assert (up - loss()) / (2 * step) == pytest.approx(g[at], abs=5e-3)
        p[at] = keep


def test_kth_largest_counts_all(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for cells in (2, 1024):
        monkeypatch.setattr(secrets, "CELLS", cells)
        for x in (rng.normal(size=300), rng.integers(0, 4, 300) / 3, np.array([1e-300, 1.0, 1.0 + 2**-52, -1e300]), np.array([-2.5])):
            rows = spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(2)
            for k in {1, len(x) // 2 or 1, secrets.kept(len(x), 0.98), len(x)}:
                assert secrets.kth_largest(rows, k) == np.sort(x)[::-1][k - 1]


def test_calibration_has_the_least_loss(spark):
    rng = np.random.default_rng(8)
    for yes, no, apart in ((60, 900, 3.0), (5, 5, 40.0), (200, 30, -1.0)):
        logit = np.r_[rng.normal(apart, 2, yes), rng.normal(0, 2, no)]
        label = np.arange(yes + no) < yes
        w = np.array(secrets.calibrated(spark.createDataFrame([(float(v), bool(k)) for v, k in zip(logit, label)], "logit double, label boolean").coalesce(2)))
        aim, weight = np.where(label, (yes + 1) / (yes + 2), 1 / (no + 2)), np.where(label, 0.5 / yes, 0.5 / no)
        x = np.c_[logit, np.ones(len(logit))]
        assert np.abs(x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - aim))).max() < 1e-5

"""Fill-in-the-middle, whitening and secret scans against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import prose
from tonelake.llm import fim, queries, secrets, whitening

BIG = 2**53
DOCS = "doc_id long, text string, output string, form string, base timestamp, v string"


def docs(spark, rows):
    """Documents beside columns whose names clash, one of them a time that Python's clocks cannot hold."""
    return spark.createDataFrame([(i, t, "x", "y", None, "z") for i, t in rows], DOCS).withColumn("base", F.expr("timestamp'1500-01-01 00:00:00'"))


# ---- 11 fill in the middle


@pytest.mark.parametrize("offsets", [[0], range(70_000), range(0, 300_000, 3), [5, 65_535, 65_536, 131_071, 131_072, 10**6], [*range(100, 9000), *range(70_000, 200_000, 7)]])
def test_boundaries_select(offsets):
    offsets = np.array(list(offsets), np.int64)
    cuts = fim.Boundaries(offsets)
    assert len(cuts) == len(offsets) and [cuts.select(k) for k in range(len(cuts))] == offsets.tolist()
    with pytest.raises(IndexError):
        cuts.select(len(cuts))


def test_boundaries_take_the_smallest_container():
    kinds = lambda x: [type(c) for c in fim.Boundaries(np.array(list(x), np.int64)).containers]
    assert kinds([1, 9, 100_000]) == [fim.Array, fim.Array]
    assert kinds(range(0, 65_536, 2)) == [fim.Bitmap] and kinds(range(65_536)) == [fim.Runs]


def plain_fim(i, text):
    """The rule word for word, by a list of lines."""
    text = text or ""
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return i, n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 50:
        return i, n, "spm", len(pre), len(mid), sha(f"<S>{suf}<P>{pre}<M>{mid}"), sha(text)
    return i, n, "psm", len(pre), len(mid), sha(f"<P>{pre}<S>{suf}<M>{mid}"), sha(text)


def test_fill_in_middle(spark, tmp_path):
    rng = random.Random(11)
    texts = [None, "", "\n", "\n\n\n", "no end", "a <S> b", "<P", "<S\nM>\n<", "é中\n😀 x\r\ny\n", "\x00a\nb", "x" * 300_000 + "\n" + "y\n" * 90_000, "\n" * 70_000, "word\n" * 40_000]
    texts += ["".join(prose(rng, rng.randint(0, 6)) + rng.choice(["\n", "\n\n", " ", "<", ">"]) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc"), (BIG + 1, "a\nb\nc"), (BIG + 3, "a\nb\nc"), (-4, "q\n"), (3, texts[3]), (3, "other\n")]
    docs(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_fill_in_middle(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, (plain_fim(i, t) for i, t in rows)))
    assert fim.transform(docs(spark, [])).collect() == []


def test_fill_in_middle_rates(spark):
    rows = [(i, "a\nb\nc\n") for i in range(400)]
    forms = [r["form"] for r in fim.transform(docs(spark, rows), rate=50, spm_rate=0).collect()]
    assert 140 < forms.count("plain") < 260 and "spm" not in forms
    assert {r["form"] for r in fim.transform(docs(spark, rows), spm_rate=100).collect()} == {"spm"}


# ---- 12 whitening


def triangles():
    rng = np.random.default_rng(12)
    turn = lambda n: np.linalg.qr(rng.normal(size=(n, n)))[0]
    square = rng.normal(size=(24, 24))
    lost = square.copy()
    lost[:, 3], lost[:, 5] = 0, lost[:, 6]
    return {
        "random": square, "one": np.array([[3.0]]), "two": rng.normal(size=(2, 2)), "equal": 3 * turn(16), "identity": np.eye(9), "nil": np.zeros((4, 4)), "rank one": np.outer(square[0], square[1]),
        "clusters": turn(30) @ np.diag(np.r_[np.full(8, 5.0), 1 + 1e-10 * np.arange(8), np.logspace(0, -12, 14)]) @ turn(30), "lost": lost, "diagonal": np.diag(np.arange(1.0, 9)),
        "graded": np.diag(np.logspace(0, -9, 20)) @ np.triu(rng.normal(size=(20, 20))), "graded up": np.diag(np.logspace(-9, 0, 20)) @ np.triu(rng.normal(size=(20, 20))), "ones": np.triu(np.ones((20, 20))),
    }


@pytest.mark.parametrize("name", triangles())
def test_bidiagonal_qd_solver(name):
    a = triangles()[name]
    diagonal, above, right = whitening.bidiagonal(a)
    want, n = np.linalg.svd(a, compute_uv=False), a.shape[1]
    size = want[0]
    assert np.abs(right.T @ right - np.eye(n)).max() < 1e-13
    b = np.diag(diagonal) + np.diag(above, 1)
    assert np.abs(right @ b.T @ b @ right.T - a.T @ a).max() < 1e-13 * max(1, size**2)
    assert np.abs(whitening.singular_values(diagonal, above) - want).max() <= 1e-14 * size
    values, vectors, total = whitening.solve(a, n)
    assert len(values) == (want > n * np.finfo(float).eps * want[0]).sum() or name in ("rank one", "lost")
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-11
    assert np.abs(a.T @ a @ vectors - vectors * values).max(initial=0) <= 1e-13 * size**2 and total == pytest.approx((want**2).sum())


def test_singular_values_are_relatively_accurate():
    """A graded bidiagonal matrix whose product of values is known: also the smallest ones are right to nearly all digits."""
    d, e = np.logspace(0, -14, 15), np.logspace(-0.5, -13.5, 14)
    got = whitening.singular_values(d, e)
    assert np.prod(got) == pytest.approx(np.prod(d), rel=1e-12)
    inverse = np.linalg.inv(np.diag(d) + np.diag(e, 1))
    assert 1 / got[-1] == pytest.approx(np.linalg.norm(inverse, 2), rel=1e-10)


def plain_whitening(rows, components=8):
    x = np.array([[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    deviation = ((n * x - sums) ** 2).sum(1)
    centred = ((n * x - sums) / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return deviation, centred @ v / np.sqrt(e), e / (centred**2).sum() * n


@pytest.mark.parametrize("parts", [1, 5, 70])
def test_whitening(spark, monkeypatch, parts):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "FACTORS", 3)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(160, 12)) @ np.diag(np.linspace(3, 0.2, 12)) + rng.normal(size=12) * 5).astype(np.float32)
    x[40:90] = x[40]  # a third of all rows is one vector
    rows = [(None if i == 7 else BIG + 2 * i + 1, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(900, None), (901, [1.0, None] * 6), (902, [float("nan")] * 12), (903, [float("-inf")] * 12)]
    table = spark.createDataFrame([(i, v, "l") for i, v in rows + bad], "vec_id long, embedding array<float>, component string").repartition(parts)
    got = whitening.whiten(table).collect()
    deviation, white, explained = plain_whitening(rows)
    at = {i: k for k, (i, _) in enumerate(rows)}
    assert len(got) == 8 * len(rows)
    sign = {r["component"]: np.sign(r["whitened"] * white[at[r["vec_id"]], r["component"] - 1]) for r in got if r["vec_id"] == BIG + 1}
    for r in got:
        k, c = at[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (len(rows), deviation[k])
        assert r["whitened"] * sign[c + 1] == pytest.approx(white[k, c], abs=1e-9) and r["explained"] == pytest.approx(explained[c], rel=1e-12)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, [])]):
        assert whitening.whiten(make(rows)).collect() == []
    got = whitening.whiten(make([(1, [1.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [5.0, 0.0])])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 1)] and got[0]["explained"] == pytest.approx(1)
    far = whitening.whiten(make([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.0])])).collect()
    assert {r["deviation"] for r in far} == {None, 1024**2} and all(np.isfinite(r["whitened"]) for r in far)


def test_exact_deviations():
    x = np.array([[2**40, -5], [3, 2**41]])
    for n in (3, 2**30):
        sums = [7 * 2**40, 11]
        d = whitening.deviations(x, n, sums)
        assert [[int(v) for v in row] for row in d] == [[n * int(v) - s for v, s in zip(row, sums)] for row in x]
    assert whitening.square_sums(np.array([[3, 4], [1 << 31, 1 << 31]])) == [25, None] and whitening.square_sums(np.array([[3_000_000_000, 300_000_000]])) == [9_090_000_000_000_000_000]


# ---- 13 secrets


def plain_base(text):
    """The three rules as they are stated."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = [k for _, k, _ in found]
    return kinds.count(0), kinds.count(1), kinds.count(2), ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


HEX_DIGITS, WIDE = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def secret_texts(seed, n=400):
    rng, rows = random.Random(seed), []
    draw = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    for i in range(n):
        text = prose(rng, rng.randint(0, 60)) + "\n" + prose(rng, 20)
        put = rng.randint(0, 9)
        if put < 3:
            text += f' token = "{draw(HEX_DIGITS, 40)}" ' + prose(rng, 5)
        elif put == 3:
            text += f" PASSWORD: {draw(WIDE, 24)} " + prose(rng, 5)
        elif put < 7:
            text += f" see http://mail{i % 9}.example.com/{prose(rng, 1)}-{prose(rng, 1)}.html and {prose(rng, 1)}.{i}@host{i}.example.org or invoice-{i:06d}-{prose(rng, 1)} "
        rows.append((i, text))
    return rows


def test_secret_rules(spark, tmp_path):
    rng, odd = random.Random(13), ["token=abc", "token='abcdef'", "TOKEN : \"a.b=c-\"", "api_key=apikey=secret=zzzzzz", "ſecret=abcdef", "api" + "K" + "ey=abcdef", "AKIA" + "A" * 15, "AKIAAKIA" + "Z9" * 6, "xAKIA" + "0" * 16 + "a", "f" * 23, "0" * 24 + "g", "deadbeef" * 5, "passwd \t= zzzzzz", "secret=\n123456", "token = " + "deadbeef" * 4, "tokentoken=passwd=abcdef", "é中😀 token=abcdéf secret:  000000"]
    rows = [(i, t) for i, t in enumerate([None, "", *odd])]
    rows += [(100 + i, " ".join(rng.choice(odd) for _ in range(rng.randint(1, 30)))) for i in range(60)] + [(BIG + 1, odd[1]), (BIG + 3, odd[1]), (None, odd[1]), (1, ""), (4, "deadbeef" * 100_000 + " " + "a1" * 50_000)]
    docs(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_secret_scan(spark, str(tmp_path)).collect()
    want = sorted(repr((i, *plain_base(t)[:3], hashlib.sha256(plain_base(t)[3].encode()).hexdigest())) for i, t in rows)
    assert sorted(repr(tuple(r)[:5]) for r in got) == want
    assert {r["spans"] for r in got if r["doc_id"] in (BIG + 1, BIG + 3)} == {"assign:0:13"}
    texts = dict(rows)
    for r in got:
        spans = [(int(s.split(":")[1]), s.split(":")[0], int(s.split(":")[2])) for s in r["spans"].split(",") if s]
        assert spans == sorted(spans, key=lambda s: (s[0], secrets.KINDS.index(s[1])))
        base = [(a, k, e) for a, k, e in spans if k != "net"]
        if r["doc_id"] not in (1, None, 4):
            assert ",".join(f"{k}:{a}:{e}" for a, k, e in base) == plain_base(texts[r["doc_id"]])[3]
        assert not any(k == "net" and any(a < f and c < e for c, j, f in base) for a, k, e in spans)


def test_secret_network_finds_unnamed_values_and_leaves_others(spark):
    rng = random.Random(5)
    draw = lambda k: "".join(rng.choice(WIDE) for _ in range(k))
    new = [(1000 + i, f"{prose(rng, 30)} ghp_{draw(36)} {prose(rng, 20)}") for i in range(40)]
    clean = [(2000 + i, f"{prose(rng, 30)} see www.{prose(rng, 1)}{i}.example.com/{prose(rng, 1)} or page-{i}-{prose(rng, 1)} {prose(rng, 20)}") for i in range(200)]
    table = docs(spark, secret_texts(1) + new + clean).repartition(4)
    got = {r["doc_id"]: r for r in secrets.scan(table).collect()}
    hit = [any(s["kind"] == "net" and (s["start"], s["end"]) == (t.index("ghp_"), t.index("ghp_") + 40) for s in got[i]["spans"]) for i, t in new]
    assert np.mean(hit) > 0.9 and not any(got[i]["base"] for i, _ in new)
    assert np.mean([bool(got[i]["spans"]) for i, _ in clean]) < 0.03
    again = {r["doc_id"]: r for r in secrets.scan(table.repartition(2)).collect()}
    assert all(again[i]["spans"] == got[i]["spans"] for i in got)


def test_secret_thresholds_keep_the_recall(spark):
    found = secrets.listed(docs(spark, secret_texts(2, 900)))
    held = secrets.listed(docs(spark, secret_texts(3, 300))).collect()
    for recall in (0.5, 0.98):
        model = secrets.fit(found, recall)
        rows = [c for r in held for c in r["found"] if c["form"] != secrets.ORDINARY]
        p = model.probability([np.frombuffer(bytes(c["seen"]), np.uint8) for c in rows])
        over = np.array([v >= model.thresholds[c["form"]] for c, v in zip(rows, p)])
        label = np.array([c["label"] for c in rows])
        assert over[label].mean() >= recall - 0.06 and over[~label].mean() < 0.02
        # Calibrated: with both labels of equal weight, the mean probability is that of the label.
        assert p[label].mean() > 0.9 and p[~label].mean() < 0.1
    assert secrets.threshold(np.array([0.9, 0.8, 0.7, 0.1]), 0.75) == 0.7 and secrets.threshold(np.array([0.4]), 0.98) == 0.4


def test_secret_gradients_and_long_rows():
    net, rng = secrets.Net(seed=2), np.random.default_rng(1)
    x, y = rng.integers(1, 256, (6, 40)), np.array([0, 1, 1, 0, 1, 0], np.float32)
    for p in net.params():
        p[...] = p.astype(np.float32)

    def loss():
        z = net.forward(x)[0].astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for p, g in zip(net.params(), net.gradients(x, y)):
        for at in [np.unravel_index(k, p.shape) for k in ([int(np.abs(g).argmax())] + rng.integers(0, p.size, 3).tolist())]:
            keep, step = p[at], np.float32(1e-2)
            p[at] = keep + step
            up = loss()
            p[at] = keep - step
            assert (up - loss()) / (2 * step) == pytest.approx(g[at], abs=2e-3)
            p[at] = keep
    secrets_block, row = secrets.BLOCK, rng.integers(1, 256, 5000).astype(np.uint8)
    whole = net.score([row])
    secrets.BLOCK = 64
    assert net.score([row]) == pytest.approx(whole)
    secrets.BLOCK = secrets_block
    edge = max(secrets.WIDTHS)
    assert net.score([row[:30]])[0] == pytest.approx(net.forward(np.pad(row[:30], (edge, edge))[None])[0][0], abs=1e-5)


def test_secrets_without_labels(spark):
    assert secrets.scan(docs(spark, [])).collect() == []
    assert secrets.fit(secrets.listed(docs(spark, [(1, None), (2, "plain words only")]))) is None
    got = secrets.scan(docs(spark, [(1, "Ab1" * 10), (2, None)])).collect()
    assert [r["spans"] for r in got] == [[], []]
    only = secrets.scan(docs(spark, [(1, "token=abcdef123")])).collect()
    assert [tuple(s) for s in only[0]["spans"]] == [(0, 15, "assign")]

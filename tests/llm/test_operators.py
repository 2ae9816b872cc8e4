"""Every operator against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.llm import chat, fingerprints, language, licences, mixing, neardup, packing, topk, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None, "x", "y") for i, t, lang, src in rows], DOCS)


def prose(rng, n, words=("ane", "bol", "cir", "dor", "eth", "fim", "gar", "hul")):
    return " ".join("".join(rng.choice(words) for _ in range(2)) for _ in range(n))


# ---- 1 exact top-k


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.4, (300, 8)), np.tile(rng.normal(0, 0.4, (1, 8)), (150, 1))]).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], "t") for i in range(len(x))]
    rows += [(905, [1.0], "t"), (906, [], "t"), (5, rows[5][1], "t"), (5, rows[5][1], "t")]
    none = [(900, None, "t"), (901, [1.0, None] * 4, "t"), (902, [float("nan")] * 8, "t"), (903, [float("inf")] * 8, "t"), (None, rows[5][1], "t")]
    v = topk.quantize(spark.createDataFrame(rows + none, "vec_id long, embedding array<float>, rank string"))
    got = topk.topk(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), k=7, chunk_rows=64, query_block=8).collect()
    full = {k: np.floor(64 * np.array([*e, *[0.0] * (8 - len(e))])).astype(np.int64) for k, (_, e, _) in enumerate(rows)}
    want = Counter()
    for i in range(0, len(x), 20):
        best = sorted((-int(full[k] @ full[i]), j) for k, (j, _, _) in enumerate(rows) if j != i)[:7]
        want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    assert Counter(tuple(r) for r in got) == want


def test_topk_few_and_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    v = topk.quantize(empty)
    assert topk.topk(v, v.withColumnRenamed("vec_id", "query_id")).collect() == []
    v = topk.quantize(spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in topk.topk(v, v.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")).collect()] == [(0, 1, 1, 64 * 32 + 128 * 32)]


# ---- 2 licences


def plain_scan(text):
    words = re.findall(licences.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, t.label) for t in licences.BASE for i in range(len(words)) if tuple(words[i : i + len(t.words)]) == t.words]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_licence_base_places(spark):
    rng = random.Random(2)
    phrases = ["CC BY-NC", "General Public License", "all rights reserved.", "ALL rights", "cc-by", "Released under the MIT License.", "rights reserved all rights reserved"]
    texts = [None, "", "!!!", "cc by", "é cc\nby Öl", "by cc by cc by"] + [" ".join(rng.choice(phrases) if rng.random() < 0.3 else prose(rng, 3) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    texts.append(" ".join([prose(rng, 40_000), "general public license"]))
    got = {r["doc_id"]: r for r in licences.scan(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        s = list(r["base_starts"])
        assert (r["n_words"], len(s), min(s, default=None), max(s, default=None), r["base_labels"]) == plain_scan(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1


def plain_labels(text, n_docs, freq):
    """Labels and score by trying every template at every place."""
    words = re.findall(licences.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, best = set(), 0.0
    for n, t in enumerate(licences.BASE + licences.LICENCES):
        key = range(len(t.words)) if n < len(licences.BASE) else range(*t.key)
        index = [i for i, w in enumerate(t.words) if i in key or w not in licences.COMMON]
        idf = {i: round((np.log((n_docs + 1) / (freq[t.words[i]] + 1)) + 1) * 1e6) for i in index}
        for start in range(-key[0], len(words)):
            at = lambda i: start + i < len(words) and start + i >= 0 and words[start + i] == t.words[i]
            if all(at(i) for i in key):
                labels.add(t.label)
                best = max(best, sum(idf[i] for i in index if at(i)) / sum(idf.values()))
    return ",".join(sorted(labels)), best


def test_licence_templates(spark):
    rng, texts = random.Random(12), ["x y Licensed under the Apache License, Version 2.0. z", "Apache helicopters hold no license", "This work is licensed under the GNU General Public License, version 3.", "plain words only", None]
    texts.append("licensed " + prose(rng, 30) + " the Apache License, Version 2.0 " + prose(rng, 5) + " licensed")  # the rare word elsewhere takes nothing away
    for t in licences.LICENCES:
        words = list(t.words)
        texts.append(" ".join(words))
        for _ in range(3):
            for at in rng.sample(range(len(words)), max(1, len(words) // 12)):
                words[at] = rng.choice(["x", "software", "license", words[at - 1]])
            texts.append(prose(rng, rng.randint(0, 9)) + " " + " ".join(words[rng.randint(0, 2) :]) + " " + prose(rng, 4))
    texts += [texts[0]] * 2
    rows = licences.scan(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    got = {r["doc_id"]: r for r in rows}
    seen = [set(re.findall(licences.WORD, (t or "").lower())) for t in texts]
    freq = Counter(w for s in seen for w in s)
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        labels, score = plain_labels(t, len(texts), freq)
        assert (got[i]["labels"], got[i]["score"]) == (labels, pytest.approx(score)), t
    assert got[0]["found"][0]["start"] == 2 and "apache-2.0" in got[5]["labels"] and got[3]["score"] == 0
    assert licences.scan(docs(spark, [])).collect() == []


def test_licence_long_repetition(spark):
    began, n = time.time(), 60_000
    r = licences.scan(docs(spark, [(1, "by cc " * n, None, None)])).first()
    assert (len(r["base_starts"]), r["base_labels"]) == (n - 1, "cc-by") and time.time() - began < 60


# ---- 3 fingerprints


def test_fingerprint_neighbours_and_edits(spark):
    rng = random.Random(3)
    ids = sorted(rng.sample(range(-50, 100_000), 40)) + [None]
    rows = [(i, None if k == 4 else "" if k == 7 else "é" + "\n".join(prose(rng, 9) + "." for _ in range(rng.randint(1, 12))), None, None) for k, i in enumerate(ids)]
    df = fingerprints.with_next_text(docs(spark, rows), rows_per_block=4)
    df = df.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text")))
    got = {r["doc_id"]: r for r in df.collect()}
    texts = [t or "" for _, t, _, _ in rows]
    for k, i in enumerate(ids):
        after = texts[(k + 1) % len(ids)]
        cut = len(texts[k]) // 4
        assert got[i]["next_text"] == after
        assert got[i]["edited"] == texts[k][: len(texts[k]) - cut] + after[:cut]
    assert fingerprints.with_next_text(docs(spark, [])).collect() == []


def test_fingerprint_repeated_rows(spark):
    rows = [(1, "b", None, None), (1, "b", None, None), (1, "a", None, None), (2, "c", None, None)]
    got = sorted((r["doc_id"], r["text"], r["next_text"]) for r in fingerprints.with_next_text(docs(spark, rows)).collect())
    assert got == [(1, "a", "b"), (1, "b", "b"), (1, "b", "c"), (2, "c", "a")]


def test_fingerprint_of_outlying_ids(spark):
    ids = [*range(300), 10**17, -(10**17), 10**18 + 3]
    rows = [(i, f"t{i}", None, None) for i in ids] + [(None, f"n{i}", None, None) for i in range(90)]
    got = {r["text"]: r["next_text"] for r in fingerprints.with_next_text(docs(spark, rows), rows_per_block=8).collect()}
    known = [f"t{i}" for i in sorted(ids)]
    assert len(got) == len(rows) and all(got[a] == b for a, b in zip(known, known[1:]))
    seen, at = [], known[-1]
    for _ in range(90):
        at = got[at]
        seen.append(at)
    assert sorted(seen) == sorted(f"n{i}" for i in range(90)) and got[at] == known[0]


def test_fingerprint_is_a_multiset_hash(spark):
    a, b = "one. two.\nthree four. five.", "six\nseven. eight"
    swapped = "three four. five.\none. two."
    df = spark.createDataFrame([(a, b, swapped, a + "\n" + b, "")], "a string, b string, s string, ab string, e string")
    for c in ("a", "b", "s", "ab", "e"):
        df = fingerprints.with_vector(df, c, "f" + c)
    f = {c: F.col("f" + c) for c in ("a", "b", "s", "ab", "e")}
    r = df.select(
        (f["a"] == f["s"]).alias("same"), (fingerprints.combine(f["a"], f["b"]) == f["ab"]).alias("added"), (fingerprints.remove(f["ab"], f["b"]) == f["a"]["lanes"]).alias("removed"),
        (f["a"]["lanes"] == f["b"]["lanes"]).alias("equal"), fingerprints.likeness(f["a"], f["s"]).alias("one"), fingerprints.likeness(f["e"], f["e"]).alias("none"),
        fingerprints.likeness(f["a"], f["e"]).alias("zero"), fingerprints.to_string(f["a"]).alias("hex"),
    ).first()
    assert r["same"] and r["added"] and r["removed"] and not r["equal"]
    assert (r["one"], r["none"], r["zero"]) == (1.0, 1.0, 0.0) and re.fullmatch("(?:[0-9a-f]{8})+", r["hex"])


def plain_pairs(text):
    """Pairs of words of a line, words cut after 16 characters; the last word of a line alone."""
    out = set()
    for line in (text or "").split("\n"):
        parts = [w[i : i + 16] for w in line.split(" ") for i in range(0, len(w), 16)]
        out |= set(zip(parts, [*parts[1:], ""]))
    return out


def test_fingerprint_likeness(spark):
    rng = random.Random(13)
    texts = ["", "one", "two words", "x" * 70, "x" * 70 + "y", "same\nlines", "lines\nsame", prose(rng, 400)]
    for _ in range(40):
        base = prose(rng, rng.randint(1, 300)).split()
        texts += [" ".join(base), " ".join(base[: len(base) * 3 // 4] + prose(rng, len(base) // 4).split())]
    one_line = prose(rng, 400)
    texts += [one_line, one_line[: len(one_line) * 3 // 4] + prose(rng, 400)[: len(one_line) // 4]]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:]))]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = {r["i"]: r["x"] for r in fingerprints.with_vector(fingerprints.with_vector(df, "a", "fa"), "b", "fb").select("i", fingerprints.likeness(F.col("fa"), F.col("fb")).alias("x")).collect()}
    for i, a, b in rows:
        p, q = plain_pairs(a), plain_pairs(b)
        exact = 1.0 if sorted(a.split("\n")) == sorted(b.split("\n")) else len(p & q) / len(p | q) if p | q else 0.0
        assert got[i] == pytest.approx(exact, abs=1e-9 if len(p | q) <= 64 else 0.25), (a, b)
    assert 0.45 < got[len(rows) - 1] < 0.75


# ---- 4 chat


def test_chat_perspectives(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, "ann", "ok"), (2, 0, "system", "only"), (None, 0, None, "x"), (1, 3, "ann", "ok")]
    got = {(r["conv_id"], r["participant"]): r for r in chat.perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    r = got[1, "ann"]
    spans = [tuple(map(int, s.split(":"))) for s in r["mask"].split(",")]
    assert [r["text"][a:b] for a, b in spans] == ["hi < |end|>" + chat.END, "ok" + chat.END, "ok" + chat.END]
    assert r["text"].startswith("<|system|>\nS<|end|>\n<|assistant|>\n") and "<|user name=bob|>\n<|end|>" in r["text"]
    assert r["target_chars"] == sum(b - a for a, b in spans) and r["n_chars"] == len(r["text"]) and r["n_turns"] == 5


def test_chat_long_conversations_are_parted(spark):
    turns = [(1, i, "ab"[i % 2], f"t{i}") for i in range(300)]
    rows = chat.perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), part_turns=50).where("participant = 'a'").orderBy("part").collect()
    assert [r["n_turns"] for r in rows] == [50] * 6
    assert re.findall(r"t\d+", "".join(r["text"] for r in rows)) == [f"t{i}" for i in range(300)]
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_chat_long_text_and_clashing_columns(spark):
    long = "word " * 300_000
    turns = [(1, 0, "ann", long, 5, "z"), (1, 1, "bob", "ok", 6, "z"), (1, 1, "bob", "ok", 6, "z")]
    got = {r["participant"]: r for r in chat.perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part long, mask string")).collect()}
    assert got["ann"]["target_chars"] == len(long) + len(chat.END) and got["bob"]["n_turns"] == 3 and long in got["bob"]["text"]


# ---- 5 urls


def test_url_rules(spark):
    want = {
        "http://a.com/en/1": ("a.com", "/en/1", "com/", "allow"), "https://X.Example.com/en/?q": ("x.example.com", "/en/", "example.com/en/", "block"),
        "https://www.example.com/en/z#f": ("www.example.com", "/en/z", "www.example.com/en/", "allow"), "http://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://q.net/fr/a": ("q.net", "/fr/a", "net/fr/", "block"), "http://notcom/x": ("notcom", "/x", None, "allow"), "http://a.com": ("a.com", "", None, "allow"),
        "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "ftp://h.org?x=/y://z": ("h.org", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None, "e") for i, u in enumerate(want)], "page_id long, url string, html string, rule string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got == want
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def plain_walk(edges, seed, rounds):
    out, mean = Counter(), sum(seed.values()) / len(seed)
    for (a, _), n in edges.items():
        out[a] += n
    rank = {h: 0.15 * m / mean for h, m in seed.items()}
    for _ in range(rounds):
        new = defaultdict(float, {h: 0.15 * m / mean for h, m in seed.items()})
        for (a, b), n in edges.items():
            new[b] += 0.85 * rank.get(a, 0) * n / out[a]
        rank = new
    return rank


@pytest.mark.parametrize("hub", [4096, 3])
def test_url_propagation_matches_a_plain_walk(spark, monkeypatch, hub):
    monkeypatch.setattr(urls, "HUB_LINKS", hub)
    rng = random.Random(5)
    hosts = [f"h{i}.org" for i in range(12)] + ["good.com", "bad.net"]
    links = [(rng.choice(hosts), rng.choice(hosts)) for _ in range(60)] + [("h0.org", f"h{i}.org") for i in range(12)]
    rows = [(i, f"http://{a}/x", f'<a href="http://{b}/y">') for i, (a, b) in enumerate(links)] + [(100, "http://good.com/", ""), (101, "http://bad.net/es/", "<a href='//h1.org/'>")]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    edges = Counter((a, b) for a, b in links if a != b) + Counter({("bad.net", "h1.org"): 1})
    allow = Counter(a for a, _ in links if a == "good.com") + Counter({"good.com": 1})
    trust = plain_walk(edges, allow, urls.rounds_for())
    distrust = plain_walk({(b, a): n for (a, b), n in edges.items()}, {"bad.net": 1.0}, urls.rounds_for())
    for h, (t, d) in got.items():
        assert t == pytest.approx(trust.get(h, 0), abs=1e-9) and d == pytest.approx(distrust.get(h, 0), abs=1e-9)


def test_url_verdicts_do_not_depend_on_the_rest(spark):
    """One host that links to a blocked one, beside ever more blocked hosts; a chain longer than eight steps; repeated rows, null and very long pages."""
    rows = [("http://odd.org/", "<a href=http://bad.net/es/>"), ("http://bad.net/es/", None), ("http://far0.org/", "<a href=http://far1.org/>"), (None, "<a href=http://x/>")]
    rows += [(f"http://far{i}.org/", f"<a href=http://far{i + 1}.org/>") for i in range(1, 11)] + [("http://far11.org/", "<p>" * 200_000 + "<a href=http://bad.net/es/>")]
    for more in (0, 3000):
        pages = [(i, u, h, "r") for i, (u, h) in enumerate(rows * 2 + [(f"http://b{k}.net/es/", "") for k in range(more)])]
        got = {r["url"]: r["verdict"] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string, rule string")).collect()}
        assert (got["http://odd.org/"], got["http://far0.org/"], got["http://bad.net/es/"], got[None]) == ("block", "block", "block", "allow")


# ---- 6 language


def test_language_held_out(spark):
    rng = random.Random(6)
    sets = {"aa": ("the", "and", "ing", "sh"), "bb": ("öß", "ich", "ein", "ü"), "cc": ("ñas", "que", "los", "é")}
    rows = []
    for i in range(360):
        lang = "abc"[i % 3] * 2
        text = " ".join("".join(rng.choice(sets[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 120)))
        rows.append((i, text, lang, None))
    rows += [(1000, None, "aa", None), (1001, "", None, None), (1002, "123 !?", "bb", None), (1003, "the and the", None, None), (1004, "que los " * 60_000, "cc", None)]
    df = docs(spark, rows)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    langs, net = language.fit(df.where(~held))
    assert langs == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in language.predict(df, langs, net, keep=("doc_id",)).collect()}
    out = [i for i in range(360) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in out]) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1004]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_without_labels(spark):
    assert language.fit(docs(spark, [])) == ([], None)
    got = language.predict(docs(spark, [(1, "abc", None, None)]), [], None, keep=("doc_id",)).collect()
    assert [tuple(r) for r in got] == [(1, "und", 0.0)]


def test_language_of_repeated_rows(spark):
    rows = [(1, "the and of it was so", "aa", None)] * 20_000 + [(2, "ich und der die das", "bb", None)] + [(i, "que los nos", None, None) for i in range(3, 9)]
    table = docs(spark, rows)
    langs, net = language.fit(table)
    assert langs == ["aa", "bb"]
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict(table.where("doc_id < 3"), langs, net, keep=("doc_id", "lang")).collect()}
    assert got == {(1, "aa"), (2, "bb")}
    assert language.fit(table.where("lang is null")) == ([], None)
    assert language.predict(docs(spark, []), langs, net, keep=("doc_id",)).collect() == []


def test_language_learns_every_label(spark):
    rng = random.Random(8)
    rows = [(i, f"{prose(rng, 4)} word{i}", f"l{i}", None) for i in range(230)]
    assert language.fit(docs(spark, rows))[0] == sorted(f"l{i}" for i in range(230))


def test_language_convolution():
    """The fast look-ups against filters slid by hand."""
    net, rng = language.Net(3, seed=5), np.random.default_rng(0)
    x = np.vstack([language.windows_of(bytes(rng.integers(0, 256, language.WINDOW, dtype=np.uint8))) for _ in range(3)] + [language.windows_of(b"short")])
    got = language.log_probs(net.freeze(), x)
    for row, out in zip(x, got):
        pooled = []
        for w in language.WIDTHS:
            for f in range(language.FILTERS):
                pooled.append(max(sum(float(net.tables[w][j][row[at + j], f]) for j in range(w)) for at in range(language.WINDOW - w + 1)))
        logits = np.tanh(np.array(pooled) + net.bias) @ net.out + net.out_bias
        assert out == pytest.approx(logits - np.log(np.exp(logits).sum()), abs=1e-4)


# ---- 7 packing


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(7)
    texts = [None, "", "a", "x<|endoftext|>y", "  two  spaces\n\n new", prose(rng, 30_000)] + [prose(rng, int(10 ** rng.uniform(0, 2.9))) + " é中 1,234's" for _ in range(160)]
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    rows = packing.pack(docs(spark, [(i, x, None, None) for i, x in enumerate(texts)] + [(None, "n", None, None)]).repartition(2)).collect()
    by_doc, by_seq = defaultdict(dict), defaultdict(dict)
    for r in rows:
        by_doc[r["doc_id"]][r["start"]] = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        by_seq[r["sequence_id"]][r["offset"]] = r["length"]
        assert r["length"] == len(r["ids"]) // 4 > 0
    for i, want in enumerate(ids):
        assert [x for s in sorted(by_doc[i]) for x in by_doc[i][s]] == want
        at = 0
        for s in sorted(by_doc[i]):
            assert s == at
            at += len(by_doc[i][s])
    assert sum(len(v) for v in by_doc[None].values()) == 2
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for o in sorted(pieces):
            assert o == at
            at += pieces[o]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.005 * sum(map(len, ids))
    short = [i for i, x in enumerate(ids) if len(x) <= 2048]
    assert np.mean([len(by_doc[i]) == 1 for i in short]) > 0.9
    assert packing.pack(docs(spark, [])).collect() == []


def test_packing_repeated_rows(spark):
    table = docs(spark, [(4, "same words", None, None)] * 30 + [(5, "other", None, None)])
    n = {r["doc_id"]: r["n"] for r in packing.pack(table).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    tokens = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(table).collect()}
    assert n == {4: 30 * tokens[4], 5: tokens[5]}


@pytest.mark.parametrize("kind", ["mixed", "even", "halves", "tiny", "equal", "long"])
def test_harmonic_bins(kind):
    rng = random.Random(kind)
    draw = {"mixed": lambda: int(10 ** rng.uniform(0, 3.8)), "even": lambda: rng.randint(1, 2048), "halves": lambda: rng.randint(1025, 2047), "tiny": lambda: rng.randint(1, 30), "equal": lambda: 700, "long": lambda: rng.randint(2049, 9000)}[kind]
    for many in (0, 1, 2, 7, 3000):
        sizes, worker, rows = [draw() for _ in range(many)], packing._Worker(5, 2048, 64), []
        for i, n in enumerate(sizes):
            rows += worker.add(i, n)
            assert len(worker.rooms) <= packing.HELD_BINS + 1 and worker.room == sum(r[0] for r in worker.rooms)
        rows += worker.close()
        pieces, bins = defaultdict(list), defaultdict(list)
        for doc, start, n, seq, offset in rows:
            pieces[doc].append((start, n))
            bins[seq].append((offset, n))
        for parts in (*pieces.values(), *bins.values()):
            parts.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        assert [sum(n for _, n in pieces[i]) for i in range(many)] == sizes
        held = [sum(n for _, n in b) for b in bins.values()]
        assert all(n <= 2048 for n in held) and sum(2048 - n for n in held if n & (n - 1)) <= 0.01 * sum(sizes)
        if many == 3000 and kind != "long":
            assert np.mean([len(pieces[i]) == 1 for i in range(many) if sizes[i] <= 2048]) > 0.6


def test_packing_vocabulary():
    """Merging each token's bytes in the file's order gives the token, so ranks by id and merges agree."""
    import json

    spec = json.load(open(packing.tokenizer_path(), encoding="utf-8"))
    assert packing.is_plain(spec)
    order = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["model"]["merges"])}
    for token in random.Random(7).sample(sorted(set(spec["model"]["vocab"]) - {"<|endoftext|>"}), 20_000):
        parts = list(token)
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: order.get((parts[i], parts[i + 1]), 1 << 30))
            assert (parts[at], parts[at + 1]) in order, token
            parts[at : at + 2] = ["".join(parts[at : at + 2])]
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}):
        assert not packing.is_plain(spec | change)


# ---- 8 mixing


def plain_targets(sizes, weights, epochs):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in capped)
        weight = sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * w[s] / weight > epochs * sizes[s]} if weight else set()
        if not over:
            return {s: epochs * sizes[s] if s in capped else left * w[s] / weight for s in names}
        capped |= over


def plain_mix(rows, targets):
    """How often each row is taken: all copies in one list, by finish time."""
    length = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda i, t: int(hashlib.md5(f"17\n{'' if i is None else i}\n{t or ''}".encode()).hexdigest()[:15], 16)
    by_source, copies, taken = defaultdict(list), [], Counter()
    for n, (i, t, _, s) in enumerate(rows):
        by_source[s].append((key(i, t), i is None, i or 0, length(t), n))
    for s, members in by_source.items():
        upto, whole = 0, sum(m[3] for m in members)
        for k, z, i, size, n in sorted(members):
            upto += size
            copies += [((upto + whole * e) / targets[s], s is None, s or "", k, z, i, n, size) for e in range(3) if size and targets[s]]
    left = sum(length(t) for _, t, _, _ in rows)
    for *_, n, size in sorted(copies):
        if size > left:
            break
        left -= size
        taken[n] += 1
    return Counter((i, s, length(t), taken[n]) for n, (i, t, _, s) in enumerate(rows))


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "TICK_ROWS", 3 if seed else 100_000)
    rng = random.Random(seed)
    sources = ["b", "a", "Z", "é", None, "tiny"]
    rows = [(i, None if i % 31 == 0 else "" if i % 37 == 0 else prose(rng, rng.randint(1, 60)), None, sources[min(5, int(rng.expovariate(0.7)))]) for i in range(600)]
    rows.append((3, rows[3][1], None, rows[3][3]))
    got = mixing.mix(docs(spark, rows), rows_per_range=50).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes, mixing.WEIGHTS, 3)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(got) == len(rows) and Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in got) == plain_mix(rows, want)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 130, (s, t, taken[s])
    assert sum(sizes.values()) - 200 <= sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(docs(spark, rows).repartition(5), rows_per_range=50).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["copies"], r["size"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = Counter((r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in mixing.mixed(docs(spark, rows)).collect())
    taken = Counter()
    for r in got:
        taken[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert mixed == +taken


def test_mixing_nothing(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    assert [r["copies"] for r in mixing.mix(docs(spark, [(1, "", None, "a"), (2, None, None, None)])).collect()] == [0, 0]


# ---- 9 warc


def test_warc_round_trip(spark):
    big = "ä" * 200_000
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" if i % 2 else f"<p>u{i}</p>") for i in range(60)]
    rows += [(100, None, None), (101, "http://e\r\nx", ""), (None, "http://n", "<p>1</p>"), (102, "http://big", big), (103, "http://r", "same"), (103, "http://r", "same"), (-5, "http://neg", "<p>1</p>")]
    got = warc.archive(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, sum string")).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in got:
        groups[r["payload_digest"]].append(r)
    by_digest = defaultdict(list)
    for i, _, h in rows:
        by_digest[warc.digest((h or "").encode())].append((i, h or ""))
    assert set(groups) == set(by_digest)
    for d, members in groups.items():
        ids = sorted((i for i, _ in by_digest[d]), key=lambda i: (i is not None, i))
        stored = [r for r in members if r["record_type"] == "response"]
        assert len(stored) == 1 and stored[0]["page_id"] == ids[-1] and bytes(stored[0]["payload"]).decode() == by_digest[d][0][1]
        assert all(r["refers_to"] == ids[-1] and r["payload"] is None for r in members if r["record_type"] == "revisit")
        assert all(r["payload_bytes"] == len(by_digest[d][0][1].encode()) for r in members)


def test_warc_is_deterministic_and_rolls(spark, tmp_path):
    rng = random.Random(9)
    pages = spark.createDataFrame([(i, f"http://h/{i}", "".join(rng.choice("abcdef") for _ in range(400))) for i in range(300)], "page_id long, url string, html string")
    make = lambda d, p: warc.write(p, f"file://{tmp_path}/{d}", shard_bytes=30_000, roll_bytes=9_000)
    a, b = (make("a", pages).orderBy("file").collect(), make("b", pages.repartition(7)).orderBy("file").collect())
    assert [(r["file"], r["sha256"], r["records"]) for r in a] == [(r["file"], r["sha256"], r["records"]) for r in b]
    assert len(a) > 4 and sum(r["records"] for r in a) == 300
    names = {p.name for p in (tmp_path / "a").iterdir() if p.is_file() and not p.name.endswith(".crc")}
    assert names == {r["file"] for r in a}
    for r in a:
        assert hashlib.sha256((tmp_path / "a" / r["file"]).read_bytes()).hexdigest() == r["sha256"]


def test_warc_of_outlying_ids_and_copies(spark, tmp_path, monkeypatch):
    rng = random.Random(19)
    ids = [*range(400), 10**17, -(10**17)]
    rows = [(i, f"http://h/{i}", "one page" if i % 3 == 0 else "".join(rng.choice("abcdef") for _ in range(400))) for i in ids] + [(None, f"http://n/{i}", f"{i}" * 300) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write(pages, f"file://{tmp_path}/w", shard_bytes=10_000)
    per = [r["n"] for r in manifest.groupBy("shard").agg(F.sum("records").alias("n")).collect()]
    assert sum(per) == len(rows) and len(per) > 10 and max(per) < 110
    got = warc.read(manifest, f"file://{tmp_path}/w").collect()
    copies = [r for r in got if r["payload_bytes"] == 8]
    assert {r["refers_to"] for r in copies if r["record_type"] == "revisit"} == {399} and sum(r["record_type"] == "response" for r in copies) == 1
    salted = {tuple(r) for r in warc.revisits(warc.payloads_of(pages), copies=5).collect()}
    assert salted == {tuple(r) for r in warc.revisits(warc.payloads_of(pages)).collect()} and len(salted) == len(copies)
    first = warc.record(7, "http://u", b"x", None, False)
    again = warc.record(8, "http://v", b"x", 7, True, "http://u")
    name = re.search(rb"WARC-Record-ID: (\S+)", first)[1]
    assert b"WARC-Refers-To: " + name in again and b"WARC-Refers-To-Target-URI: http://u" in again


def test_warc_threshold_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "v", "long enough"), (4, "w", "long enough")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive(pages, least_bytes=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# ---- 10 near duplicates


def plain_classes(texts):
    sets, keys = [], []
    for t in texts:
        words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
        keys.append(" ".join(words) if words else "=" + (t or ""))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if keys[i] == keys[j] or (both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_neardup_classes(spark):
    rng = random.Random(10)
    texts = [None, "", "", "!!", "!!", "?", "one two", "One, two!", "a b c d e"]
    for _ in range(25):
        base = prose(rng, rng.randint(20, 150)).split()
        for _ in range(rng.choice([1, 1, 2, 4, 14])):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 60)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            texts.append(" ".join(copy))
    want = plain_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == want


def families():
    """Four times 250 copies of a text with two to four words changed: many of them about 0.8 alike."""
    rng, texts = random.Random(1), []
    for changed in (2, 3, 3, 4):
        base = prose(rng, 200).split()
        for _ in range(250):
            copy = list(base)
            for at in rng.sample(range(200), changed):
                copy[at] = prose(rng, 2).replace(" ", "")
            texts.append(" ".join(copy))
    return texts


def test_neardup_of_large_families(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 100, raising=False)
    texts = families()
    want = plain_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert len(set(want)) == 330 and [got[i] for i in range(len(texts))] == want


def test_neardup_classes_do_not_depend_on_sizes(spark, monkeypatch):
    texts = families()
    table = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    once = sorted(tuple(r) for r in neardup.classes(table).select("doc_id", "class_id").collect())
    # As if there were more rows than one task takes.
    for name, value in {"BUCKET_ROWS": 9, "LINK_CHUNK": 20, "BLOCK_ROWS": 150}.items():
        monkeypatch.setattr(neardup, name, value, raising=False)
    assert sorted(tuple(r) for r in neardup.classes(table).select("doc_id", "class_id").collect()) == once


def test_neardup_of_repeated_lines(spark):
    rng, texts = random.Random(3), []
    for times in (5, 10, 30, 30, 30, 100):
        words = prose(rng, 104).split()
        texts += [" ".join(words), " ".join(words[:40] + words[40:52] * times + words[52:])]
    want = plain_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert len(set(want)) == 6 and [got[i] for i in range(len(texts))] == want


def test_neardup_keeps_one_of_each(spark):
    rows = [(5, "a b c d e f", "l", "s"), (3, "A b c d e f", "m", "t"), (3, "A b c d e f", "m", "t"), (9, "other words stand here now", None, None), (None, "other words stand here now", None, None), (7, None, None, None)]
    got = sorted((r["doc_id"], r["text"], r["lang"]) for r in neardup.deduplicated(docs(spark, rows)).collect())
    assert got == [(3, "A b c d e f", "m"), (7, None, None), (9, "other words stand here now", None)]
    assert neardup.deduplicated(docs(spark, [])).collect() == []


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.9):
        n = 400
        both = int(n * share)
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[:both], rng.integers(0, 2**63, n - both).astype(np.uint64)])
        s = neardup.signatures([a, b])
        jaccard = both / (2 * n - both)
        assert abs((s[0] == s[1]).mean() - jaccard) < 0.12
    s = neardup.signatures([np.array([7, 7, 7, 9], np.uint64)])
    assert 0.6 < (s[0] == 7).mean() < 0.9


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_components_of_a_path(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "LINK_CHUNK", chunk)
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(1, 40)] + [(b"x", b"y")], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in neardup.components(links).collect()}
    assert got == {bytes([i]): bytes([1]) for i in range(1, 41)} | {b"x": b"x", b"y": b"x"}

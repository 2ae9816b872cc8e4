"""Near-duplicate documents by ProbMinHash, banding and verification.

A text is its lower-cased words, its elements the shingles of five words, each
weighted by how often it occurs.  Every element sends out arrivals of a
Poisson process of its weight over the signature's components; a component
keeps the element that arrives first, and an element stops as soon as its next
arrival is later than the slowest component.  Two signatures agree in a
component with the texts' probability Jaccard similarity.  As the sets of
shingles decide, whatever their counts, a text with repeats has a second
signature with all weights 1; its bands are added, and it alone is the estimate.

Texts of equal words are one node.  Nodes that agree in a whole band meet in a
bucket.  In buckets of up to ``ALL_PAIRS`` nodes all pairs are compared, in a
larger one every node with a hub.  Large buckets that still hold several
classes are then searched in full: nodes joined by them are a group, groups
are cut into blocks, and any two blocks meet in one task, which compares all
pairs that share a band and are not of one class yet.  Rows of a hot bucket are
dealt over several tasks wherever buckets are joined.  In the first pass pairs
whose signatures rule the similarity out go before any text is read; for all
others, and in the second pass for all, the exact Jaccard similarity of the
texts' shingle sets decides.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_keys, materialize, release, salted, spread, text_of

WORDS = 5
SIMILAR = 0.8
BANDS = 32
ROWS = 4
#: Signature components; the first BANDS * ROWS make the bands, all of those without weights the estimate.
COMPONENTS = 256
#: A pair is left out where its signatures agree so many standard deviations less than similar ones do.
SIGMAS = 4.5
ALL_PAIRS = 8
#: Buckets of more rows are dealt over tasks by salts.
BUCKET_ROWS = 512
#: So many links at once are shortened to stars inside a task.
LINK_CHUNK = 100_000
#: Rows and bytes of shingles in a block of the second pass.
BLOCK_ROWS = 2048
BLOCK_BYTES = 16 << 20
BATCH_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C55)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normalised(text: str) -> np.ndarray:
    """Lower-cased UTF-8 bytes: words parted by one space each."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    word = _WORD[raw]
    ends = np.zeros(len(raw), bool)
    ends[1:] = word[:-1] & ~word[1:]
    kept = np.where(word, raw, np.uint8(32))[word | ends]
    return kept[:-1] if len(kept) and kept[-1] == 32 else kept


def shingles(norm: np.ndarray, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of all runs of ``words`` words, in order, with repeats.

    A text of fewer words is one shingle; one without words has none.
    """
    n = len(norm)
    if not n:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(norm == 32)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, n]
    k = min(words, len(starts))
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    powers = np.empty(n, np.uint64)
    powers[0] = 1
    powers[1:] = _P
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((norm.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    back = np.full(n, _P_INVERSE, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def signatures(elements: list[np.ndarray], m: int = COMPONENTS) -> np.ndarray:
    """``(texts, m)`` ProbMinHash signatures of non-empty shingle lists."""
    out = np.zeros((len(elements), m), np.uint64)
    todo, hashes, weights = [], [], []
    for i, e in enumerate(elements):
        u, c = np.unique(e, return_counts=True)
        if len(u) == 1:
            out[i] = u[0]
        else:
            hashes.append(u)
            weights.append(c)
            todo.append(i)
    if not todo:
        return out
    doc = np.repeat(np.arange(len(todo)), [len(h) for h in hashes])
    h, rate = np.concatenate(hashes), 1.0 / np.concatenate(weights)
    first = np.full(len(todo) * m, np.inf)
    who = np.zeros(len(todo) * m, np.uint64)
    time = np.zeros(len(h))
    step = 0
    while len(h):
        step += 1
        draw = mix64(h + np.uint64(step * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        unit = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(unit) * rate
        at = doc * m + (mix64(draw ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        mine = first[at] == time
        who[at[mine]] = h[mine]
        slowest = first.reshape(-1, m).max(1)
        live = time < slowest[doc]
        doc, h, rate, time = doc[live], h[live], rate[live], time[live]
    out[todo] = who.reshape(-1, m)
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    """``(texts, BANDS)`` band hashes, the band's number mixed in."""
    part = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
    h = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :].repeat(len(sig), 0)
    for r in range(ROWS):
        h = mix64(h ^ part[:, :, r]) * np.uint64(0x9FB21C651E98DF25)
    return h.view(np.int64)


def weightless(lists: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Signatures of the shingle lists as sets, and the bands of both: by weight and as sets.

    Without repeats the two are the same.
    """
    sig, sets = signatures(lists), [np.unique(e) for e in lists]
    plain, bands = sig.copy(), list(bands_of(sig))
    again = [i for i, e in enumerate(lists) if len(sets[i]) < len(e)]
    if again:
        plain[again] = signatures([sets[i] for i in again])
        for i, row in zip(again, bands_of(plain[again])):
            bands[i] = np.unique(np.concatenate([bands[i], row]))
    return plain, bands


def sketch(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, node, bands, sig)``; ``node`` is a digest of the text's words.

    A text without words is its own bytes' digest and has no bands; ``key`` is
    a hash of the text as it is, ``bands`` those by weight and those of the
    shingles as a set, ``sig`` one byte of each of the set's components, mixed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, texts, start = b.column(0), b.column(1), b.column(2), 0
            while start < len(texts):
                stop, size, nodes, lists, have = start, 0, [], [], []
                while stop < len(texts) and (size < BATCH_BYTES or stop == start):
                    text = texts[stop].as_py()
                    norm = normalised(text)
                    data = norm.tobytes() if len(norm) else b"\0" + text.encode("utf-8", "replace")
                    nodes.append(hashlib.blake2b(data, digest_size=16).digest())
                    if len(norm):
                        have.append(stop - start)
                        lists.append(shingles(norm))
                    size += len(text)
                    stop += 1
                bands: list = [[] for _ in nodes]
                sigs: list = [b"" for _ in nodes]
                if lists:
                    plain, rows = weightless(lists)
                    small = (plain >> np.uint64(17)).astype(np.uint8)
                    for i, row, code in zip(have, rows, small):
                        bands[i], sigs[i] = row, code.tobytes()
                # Ids and keys never become Python numbers.
                made = [ids.slice(start, stop - start), keys.slice(start, stop - start), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "key", "node", "bands", "sig"])
                start = stop

    return keyed(docs).mapInArrow(run, "doc_id long, key long, node binary, bands array<long>, sig binary")


def keyed(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("_text"))


def _bound(least: float) -> float:
    """Equal components below which two signatures are not looked into."""
    agree = least + (1 - least) / 256
    return COMPONENTS * (agree - SIGMAS * (agree * (1 - agree) / COMPONENTS) ** 0.5)


def close(pairs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Those ``(a, b)`` of ``(node, other, ca, cb)`` whose signatures do not rule the similarity out."""
    bound = _bound(least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x = np.frombuffer(b"".join(p["ca"]), np.uint8).reshape(len(p), COMPONENTS)
                y = np.frombuffer(b"".join(p["cb"]), np.uint8).reshape(len(p), COMPONENTS)
                p = p[(x == y).sum(1) >= bound]
            yield p[["a", "b"]].drop_duplicates()

    ordered = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "ca", "cb")
    return ordered.mapInPandas(run, "a binary, b binary").distinct()


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Those ``(a, b)`` of ``pairs`` whose texts are similar enough.

    ``texts`` has ``(node, text)``, one row per node.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hub, mine = None, None
            keep = []
            for a, x, y in zip(batch["a"], batch["ta"], batch["tb"]):
                if a != hub:
                    hub, mine = a, np.unique(shingles(normalised(x)))
                other = np.unique(shingles(normalised(y)))
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(both >= least * (len(mine) + len(other) - both) - 1e-9)
            yield batch.loc[keep, ["a", "b"]]

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInPandas(run, "a binary, b binary")


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links with the same components: union-find over ``LINK_CHUNK`` links at a time, every node to its least."""
    up: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def stars() -> pd.DataFrame:
        links = [(x, find(x)) for x in up]
        up.clear()
        return pd.DataFrame([(x, r) for x, r in links if x != r], columns=["a", "b"])

    seen = 0
    for p in batches:
        for a, b in zip(p["a"], p["b"]):
            low, high = sorted((find(bytes(a)), find(bytes(b))))
            up[high] = low
            seen += 1
            if seen % LINK_CHUNK == 0:
                yield stars()
    yield stars()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``: its component's least node.

    Tasks first shorten their own links to stars.  Then rounds link each
    node's larger neighbours to its least neighbour and its smaller ones
    likewise, until nothing changes; hubs lose all but one of their links in a
    round, and each round is cut off by a table.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mark_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    edges = materialize(links.where("a <> b").distinct().mapInPandas(_stars, "a binary, b binary"), "links", 100_000)
    mark = mark_of(edges)
    while mark[0]:
        near = both(edges)
        # Least neighbours are read from a table: Spark knows its size, broadcasts it below its threshold and splits hubs in the join otherwise.
        least = materialize(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = materialize(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "stars")
        low = materialize(small.groupBy("a").agg(F.min("b").alias("m")), "least")
        linked = small.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(linked, "links")
        now = mark_of(new)
        for used in (edges, least, small, low):
            discard(used)
        edges = new
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``(doc_id, key, class_id, class_docs, class_key)``, one row per row of ``docs``.

    ``class_id`` is the smallest ``doc_id`` of the documents that are linked,
    directly or through others, by ``least`` similarity of their five-word
    shingles or by equal words, and ``class_docs`` their number.  Null and
    empty texts are one class, other texts without words are classes of equal
    texts; rows of a repeated id with different texts stand for themselves;
    null ids come last, and a class of null ids only has a null ``class_id``.
    ``class_key`` is the text hash of the class's first row, ``(doc_id, key)``.
    """
    seen = materialize(sketch(docs), "sketches")
    top = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    nodes = materialize(seen.groupBy("node").agg(top.alias("top"), F.count("*").alias("docs"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("hub"))).alias("y")).where("n > 1")
    sizes = materialize(sizes.select("bucket", "n", "y.hub"), "bucket-sizes")
    hot = hot_keys(sizes, ["bucket"], BUCKET_ROWS)
    members = salted(members, hot, ["bucket"], F.col("node")).join(spread(sizes, hot, ["bucket"]), ["bucket", "salt"])
    members = materialize(members.select("bucket", "salt", "node", "n", "hub"), "buckets")

    wanted = materialize(members.select("node").distinct().join(nodes.select("node", "top", "sig"), "node").select("node", F.col("top.doc_id").alias("_id"), F.col("top.key").alias("_key"), "sig"), "wanted")
    rows = keyed(docs)
    texts = rows.join(wanted.drop("sig"), (rows["key"] == wanted["_key"]) & rows["doc_id"].eqNullSafe(wanted["_id"])).select("node", F.col("_text").alias("text"))
    again = seen.groupBy("doc_id", "key").count().where("count > 1")
    texts = materialize(texts if again.isEmpty() else texts.dropDuplicates(["node"]), "texts")

    roots = materialize(wanted.select("node", F.col("node").alias("root"), "sig"), "classes")
    pairs = materialize(close(_bucket_pairs(members, roots), least), "pairs")
    roots = _joined(roots, materialize(verified(pairs, texts, least), "found"))
    discard(pairs)
    # Buckets that are one class by now hold nothing more to find.
    rest = materialize(_open(members, roots, hot), "open")
    discard(members)
    discard(sizes)
    discard(wanted)
    if not rest.isEmpty():
        release(docs.sparkSession)
        roots = _joined(roots, materialize(_across(rest, roots, nodes, texts, least), "found"))
    for used in (rest, texts, hot):
        discard(used)

    per = nodes.select("node", "top", "docs").join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = per.groupBy("root").agg(F.min("top").alias("first"), F.sum("docs").alias("class_docs"))
    named = per.select("node", "root").join(whole, "root").select("node", "first", "class_docs")
    out = seen.select("doc_id", "key", "node").join(named, "node")
    return out.select("doc_id", "key", F.col("first.doc_id").alias("class_id"), "class_docs", F.col("first.key").alias("class_key"))


def deduplicated(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The first row of each class, with all columns of ``docs``, of whatever type or name; they do not pass through Python."""
    own = {x: f"_{x}_{uuid.uuid4().hex}" for x in ("text", "id", "key", "again")}  # no column of docs is called so
    kept = classes(docs, least).where("doc_id <=> class_id and key = class_key")
    kept = materialize(kept.groupBy(F.col("doc_id").alias(own["id"]), F.col("key").alias(own["key"])).agg((F.count("*") > 1).alias(own["again"])), "kept")
    rows = docs.withColumn(own["text"], F.xxhash64(text_of()))
    rows = rows.join(kept, (F.col(own["text"]) == F.col(own["key"])) & F.col("doc_id").cast("long").eqNullSafe(F.col(own["id"])))
    once, again = rows.where(~F.col(own["again"])).drop(*own.values()), rows.where(own["again"]).dropDuplicates([own["id"], own["key"]]).drop(*own.values())
    return once.unionByName(again) if not kept.where(own["again"]).isEmpty() else once


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after the classes of linked nodes became one."""
    if links.isEmpty():
        return roots
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(named("a"), "a").join(named("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    to = components(between).select(F.col("node").alias("root"), F.col("root").alias("to"))
    new = materialize(roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"), "sig"), "classes")
    discard(roots)
    return new


def _bucket_pairs(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``(node, other, ca, cb)``: all pairs of small buckets, each node and the hub of large ones.

    Pairs that meet in several buckets are made one before the signatures are
    joined to them.
    """
    star = members.where((F.col("n") > ALL_PAIRS) & (F.col("node") != F.col("hub"))).select("node", F.col("hub").alias("other"))
    few = members.where(F.col("n") <= ALL_PAIRS).groupBy("bucket").agg(F.collect_list("node").alias("all"))  # at most ALL_PAIRS each
    few = few.select(F.explode("all").alias("node"), "all").select("node", F.explode("all").alias("other")).where("node < other")
    both = star.unionByName(few).select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other")).distinct()
    code = lambda n, c: roots.select(F.col("node").alias(n), F.col("sig").alias(c))
    return both.join(code("node", "ca"), "node").join(code("other", "cb"), "other")


def _open(members: DataFrame, roots: DataFrame, hot: DataFrame) -> DataFrame:
    """``(node, hub)`` of the large buckets that still hold several classes, ``hub`` a bucket's least node."""
    rows = members.where(F.col("n") > ALL_PAIRS).select("bucket", "salt", "node").join(roots.select("node", "root"), "node")
    several = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("node").alias("least")).where("x <> y").select("bucket", F.col("least").alias("hub"))
    return rows.join(spread(several, hot, ["bucket"]), ["bucket", "salt"]).select("node", "hub").distinct()


def _across(rest: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` that join all classes of ``rest (node, hub)`` with similar texts in a common bucket.

    Nodes joined by buckets, directly or through others, are a group.  A group
    is cut into blocks, and any two blocks meet in one task, so that every pair
    of a group is looked at and no task grows with it.
    """
    groups = components(rest.select(F.col("hub").alias("a"), F.col("node").alias("b"))).withColumnRenamed("root", "group")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "elements": [np.unique(shingles(normalised(t))).tobytes() for t in b["text"]]})

    elements = texts.join(groups.select("node"), "node").mapInPandas(cut, "node binary, elements binary")
    rows = groups.join(roots.select("node", "root"), "node").join(nodes.select("node", "bands"), "node").join(elements, "node")
    rows = materialize(rows, "rest")
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.length("elements")).alias("size"), F.min("root").alias("x"), F.max("root").alias("y"))
    blocks = sizes.where("x <> y").select("group", F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    tasks = int(blocks.agg(F.sum(F.expr("blocks * (blocks + 1) div 2"))).first()[0] or 1)
    rows = rows.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root", "bands", "elements")
    keys = ["group", "low", "high"]
    return rows.repartition(min(tasks, 1000), *keys).groupBy(*keys).applyInPandas(lambda p: _block_links(p, least), "a binary, b binary")


class _Lists:
    """Lists of numbers, and how many of them one row's list shares with others'."""

    def __init__(self, lists: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        known, self.ids = np.unique(np.concatenate(lists), return_inverse=True)
        self.flag = np.zeros(len(known), np.int32)

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        mine = self.ids[self.starts[i] : self.starts[i] + self.sizes[i]]
        self.flag[mine] = 1
        sizes = self.sizes[others]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.starts[others] - starts, sizes)
        counts = np.add.reduceat(self.flag[self.ids[at]], starts)
        self.flag[mine] = 0
        return counts


def _block_links(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between similar texts of different classes that share a band, one for each class met; those of two blocks where there are two."""
    rows = rows.sort_values("block", kind="stable", ignore_index=True)
    across = rows["low"].iloc[0] != rows["high"].iloc[0]
    first = int((rows["block"] == rows["low"]).sum())
    node, label = rows["node"].to_list(), pd.factorize(rows["root"].map(bytes))[0]
    bands, texts = _Lists([np.asarray(b) for b in rows["bands"]]), _Lists([np.frombuffer(e, np.uint64) for e in rows["elements"]])
    n, links = texts.sizes, []
    for i in range(first):
        j = np.arange(first if across else i + 1, len(rows))
        j = j[(label[j] != label[i]) & (np.minimum(n[j], n[i]) >= least * np.maximum(n[j], n[i]) - 1e-9)]
        j = j[bands.shared(i, j) > 0] if len(j) else j
        if len(j):
            both = texts.shared(i, j)
            j = j[both >= least * (n[i] + n[j] - both) - 1e-9]
            met, at = np.unique(label[j], return_index=True)
            links += [(node[i], node[k]) for k in j[at]]
            label[np.isin(label, met)] = label[i]
    return pd.DataFrame(links, columns=["a", "b"])

"""Document fingerprints: a homomorphic multiset hash, DataFrame functions only.

A fingerprint has two parts.  Its lanes are sums: every paragraph (line) adds
``LANES`` 32-bit hashes, lane by lane, modulo ``2**32``.  Sums do not depend on
order, so equal multisets of paragraphs have equal lanes, and adding or taking
away paragraphs is adding or subtracting theirs (:func:`combine`,
:func:`remove`).  Its sketch is the ``SKETCH`` least of the 32-bit hashes of the
text's word pairs; it estimates how alike two texts are, as the Jaccard
similarity of their pairs, exactly where both texts have few.  Pairs do not
reach over a paragraph's end, so sketches of parts are merged likewise.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cell_of, id_bounds, materialize, small_table, text_of

LANES = 16
SKETCH = 64
_MASK32 = (1 << 32) - 1
#: A word, at most 16 characters of it, and the next one of the line; longer runs without spaces are taken in such steps.
PAIR = r"(?=(\S{1,16}[^\S\n]*\S{0,16}))\S{1,16}\s*"


def _sum(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, p: (a + of(p)).bitwiseAND(F.lit(_MASK32)))


def _lane(i: int, paragraph: Column) -> Column:
    return F.xxhash64(F.lit(i), paragraph["a"], paragraph["b"]).bitwiseAND(F.lit(_MASK32))


def _least(hashes: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH)


def with_vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds column ``name``, ``struct<lanes, sketch>``: the fingerprint of column ``text``.

    The empty text is one empty paragraph without words; null is read as empty.
    """
    whole = text_of(text)
    df = df.withColumns({
        "_paragraphs": F.transform(F.split(whole, "\n", -1), lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit(71), p).alias("b"))),
        "_pairs": F.transform(F.regexp_extract_all(whole, F.lit(PAIR), F.lit(1)), lambda p: F.xxhash64(p).bitwiseAND(F.lit(_MASK32))),
    })
    lanes = [_sum(F.col("_paragraphs"), partial(_lane, i)) for i in range(LANES)]
    return df.withColumn(name, F.struct(F.array(*lanes).alias("lanes"), _least(F.col("_pairs")).alias("sketch"))).drop("_paragraphs", "_pairs")


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    return F.zip_with(a["lanes"], b["lanes"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))


def combine(a: Column, b: Column) -> Column:
    """Fingerprint of both texts' paragraphs together (insertion)."""
    return F.struct(_lanewise(a, b, 1).alias("lanes"), _least(F.concat(a["sketch"], b["sketch"])).alias("sketch"))


def remove(a: Column, b: Column) -> Column:
    """Lanes of ``a`` without the paragraphs of ``b`` (deletion); a sketch cannot be taken back, it is made anew from what is left."""
    return _lanewise(a, b, -1)


def to_string(v: Column) -> Column:
    """Lower-case hexadecimal, eight digits a number: the lanes, then the sketch."""
    return F.array_join(F.transform(F.concat(v["lanes"], v["sketch"]), lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word pairs as the sketches show it; 1 where the lanes are equal."""
    least = _least(F.concat(a["sketch"], b["sketch"]))
    both = F.size(F.array_intersect(least, F.array_intersect(a["sketch"], b["sketch"])))
    return F.when(a["lanes"] == b["lanes"], 1.0).when(F.size(least) == 0, 0.0).otherwise(both / F.size(least))


def with_next_text(docs: DataFrame, rows_per_block: int = 512, vectors: bool = False) -> DataFrame:
    """``(doc_id, text, next_text)``: the text that follows by ``doc_id``; with ``vectors`` also both texts' ``own`` and ``next``.

    Documents go to blocks of near-equal numbers of rows: cells between
    quantiles of a sample of ids, parted evenly inside, so an outlying id
    costs its own cell only.  One shuffle of the texts and a window in each
    block finds every neighbour but that of a block's last row, which gets the
    first text of the next block.  Rows of one id are in one block, ordered by
    text; null ids come last, ordered by a hash of the text; the first row
    follows the last one.  An empty table gives no rows.
    """
    text = text_of()
    # Rows are ordered by z, k and text.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("doc_id").isNull().alias("z"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("k"))
    n = docs.count()
    if not n:
        return _named(rows.withColumn("next_text", F.lit("")), vectors)
    share = max(rows_per_block, n // 100_000)  # so the heads of blocks are few
    bounds = id_bounds(docs, "doc_id", n, min(4096, -(-n // share)))
    rows = cell_of(rows, "doc_id", bounds, "a")
    # One row a cell, 4,097 at most.
    cells = rows.groupBy("a").agg(F.count("*").alias("n"), F.min(F.when(~F.col("z"), F.col("k"))).alias("lo"), F.max(F.when(~F.col("z"), F.col("k"))).alias("hi")).collect()
    parts = []
    for c in cells:
        lo, hi = (-float(1 << 63), float(1 << 63)) if c["lo"] is None else (float(c["lo"]), float(c["hi"]))
        m = max(1, -(-c["n"] // share))
        parts.append((c["a"], lo, max(1.0, (hi - lo) / m), m))
    table = F.broadcast(small_table(docs.sparkSession, parts, "a int, lo double, width double, m int"))
    within = F.greatest(F.lit(0), F.least(F.col("m") - 1, F.floor((F.col("k").cast("double") - F.col("lo")) / F.col("width")).cast("int")))
    rows = rows.join(table, "a").select("doc_id", "text", "z", "k", "a", within.alias("b"))
    inside = Window.partitionBy("a", "b").orderBy("z", "k", "text")
    near = rows.withColumn("near", F.lead("text").over(inside))
    if vectors:
        near = with_vector(near, "text", "own")
        near = near.withColumn("near_fp", F.lead("own").over(inside))

    head = F.min(F.struct("z", "k")).alias("head")
    heads = rows.groupBy("a", "b").agg(head)
    whole = Window.partitionBy(F.lit(0)).orderBy("a")  # one row a cell, 4,097 at most
    first = F.first("head").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    above = heads.groupBy("a").agg(F.min("head").alias("head")).select("a", F.coalesce(F.lead("head").over(whole), first).alias("far"))
    chained = heads.select("a", "b", F.lead("head").over(Window.partitionBy("a").orderBy("b")).alias("here")).join(above, "a")
    chained = materialize(chained.select("a", "b", F.coalesce("here", "far").alias("at")).select("a", "b", F.col("at.z").alias("nz"), F.col("at.k").alias("nk")), "next-heads")
    # The heads are read from a table, so their size is known and Spark broadcasts them only below its threshold.
    wanted = chained.join(rows.select("z", "k", "text"), (F.col("nz") == F.col("z")) & (F.col("nk") == F.col("k")))
    far = wanted.groupBy("a", "b").agg(F.min("text").alias("far"))
    far = materialize(with_vector(far, "far", "far_fp") if vectors else far, "next-texts")
    near = near.join(far, ["a", "b"], "left").withColumn("next_text", F.coalesce("near", "far", F.lit("")))
    return _named(near, vectors, F.coalesce("near_fp", "far_fp") if vectors else None)


def _named(rows: DataFrame, vectors: bool, following: Column | None = None) -> DataFrame:
    if not vectors:
        return rows.select("doc_id", "text", "next_text")
    if following is None:
        rows = with_vector(rows, "text", "own")
        following = F.col("own")
    return rows.select("doc_id", "text", "next_text", "own", following.alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The last quarter replaced by as many first code points of ``following``."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, fp)`` of whole texts; see :func:`with_vector`."""
    rows = docs.select("doc_id", text_of().alias("text"))
    return with_vector(rows, "text", "fp")

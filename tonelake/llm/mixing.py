"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash.  A document's virtual finish
time is the number of its source's tokens up to and with it, divided by the
source's target; further epochs of a source go on counting.  All documents
are ordered by finish time and the mix is what comes before the total budget
is used up.

Both orders are cut into ranges of near-equal size, ranges are summed and
added up, and only then are rows counted inside their range, so no task ever
holds a source or the whole order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
TOKEN = r"[^\x20\x09-\x0D]+"
_TICKS = 1 << 16
#: A tick with more copies is cut into finer ticks before its copies are ordered in one task.
TICK_ROWS = 100_000


def shuffle_key() -> Column:
    """A document's place in the shuffle: 60 bits of the MD5 of its id and text."""
    digest = F.md5(F.concat(F.lit("17\n"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), text_of()))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, key)``; ``key`` is the place in the shuffle."""
    return docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(TOKEN)).cast("long").alias("size"), shuffle_key().alias("key"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``(source, docs, source_size, target)``, one row per source; the windows here hold a row a source, never documents.

    Sources by code point, null last, take the weights in turn and share the
    total.  Where a share exceeds ``epochs`` times the source's size it stops
    there and the rest is shared anew: in the order of cap over weight, a
    source is capped as long as its cap is below its share of what the capped
    sources before it have left.
    """
    per = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * epochs)
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    per = per.withColumns({
        "total": F.sum("source_size").over(whole),
        "used": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    share = (F.col("total") - F.col("used")) / F.col("left")
    per = per.withColumn("capped", F.col("cap") <= share * F.col("weight"))
    per = per.withColumn("rate", F.min(F.when(~F.col("capped"), F.struct(F.col("used").alias("used"), share.alias("share")))).over(whole).getField("share"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("rate") * F.col("weight"))
    return per.select("source", "docs", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, rows_per_range: int = 1024) -> DataFrame:
    """``(doc_id, source, size, key, source_size, target, copies, finish)`` of each row.

    ``copies`` is how often the mix takes the document, 0 to ``epochs``, and
    ``finish`` the virtual time of the first copy.  Null and empty texts have
    size 0 and are never taken; a null source is a source; repeated rows are
    documents of their own, told apart by their order among equals; an empty
    table gives no rows.  Reruns agree: every order is total but for equal
    rows, which are interchangeable.
    """
    rows = materialize(sized(docs), "mix-sizes")
    per = materialize(targets(rows, weights, epochs), "mix-targets")
    facts = per.agg(F.sum("docs").alias("n"), F.sum("source_size").alias("total")).first()
    n, total = facts["n"] or 0, facts["total"] or 0
    ranges = max(1, n // rows_per_range)
    # Hashes are even, so equal slices of their range hold near-equal numbers of rows; equal keys stay together.
    slot = F.least(F.lit(ranges - 1), F.floor(F.col("key") / F.lit(2.0**60) * ranges)).cast("long")
    rows = rows.withColumn("slot", slot)
    # One row per source: read from a table, so Spark broadcasts it only below its threshold.
    facts_of = per.select(F.col("source").alias("s"), "source_size", "target")
    sums = rows.groupBy("source", "slot").agg(F.sum("size").alias("mass"))
    ahead = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("mass").over(ahead), F.lit(0)))
    sums = sums.join(facts_of, sums["source"].eqNullSafe(facts_of["s"])).select(F.col("source").alias("s"), F.col("slot").alias("t"), "base", "source_size", "target")
    inside = Window.partitionBy("source", "slot").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumn("within", F.sum("size").over(inside))
    at = at.join(sums, at["source"].eqNullSafe(sums["s"]) & (at["slot"] == sums["t"]))
    at = at.select("doc_id", "source", "size", "key", "source_size", "target", (F.col("base") + F.col("within")).alias("upto"))
    at = materialize(at, "mix-order")

    def finish(epoch: int) -> Column:
        return F.when((F.col("size") > 0) & (F.col("target") > 0), (F.col("upto") + F.col("source_size") * epoch) / F.col("target"))

    def place(time: Column) -> Column:
        """Place in the whole order: by time, source, key and id, nulls last."""
        return F.struct(time.alias("f"), F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"), F.col("key").alias("k"), F.col("doc_id").isNull().alias("z"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"))

    copies = at.select("size", "source", "key", "doc_id", F.explode(F.array(*[finish(e) for e in range(epochs)])).alias("finish")).where("finish is not null")
    last = _last_place(copies.select("size", place(F.col("finish")).alias("at")), total)
    count = F.lit(0)
    if last is not None:
        end = F.struct(*[F.lit(x).alias(c) for c, x in zip("fnskzd", last)])
        for e in range(epochs):
            count = count + F.when(finish(e).isNotNull() & (place(finish(e)) <= end), 1).otherwise(0)
    return at.select("doc_id", "source", "size", "key", "source_size", "target", count.cast("int").alias("copies"), finish(0).alias("finish"))


def _last_place(copies: DataFrame, total: int) -> tuple | None:
    """The last place that the budget reaches, of ``copies (size, at)``; None if it reaches none.

    Tokens are counted by ticks of time; the tick in which the budget runs out
    is cut into finer ones until it holds few copies, and only those are put in
    order in one task.  Copies of one time are one for a source and epoch.
    """
    low, width, spent, near = 0.0, 2.0 / _TICKS, 0, copies
    # The order of finish times ends near 1, so all that comes after 2 is one tick.
    cells, top = _TICKS, _TICKS
    while True:
        tick = F.least(F.floor((F.col("at.f") - F.lit(low)) / F.lit(width)), F.lit(top)).cast("long")
        ticks = near.groupBy(tick.alias("tick")).agg(F.sum("size").alias("mass"), F.count("*").alias("n"))
        line = Window.partitionBy(F.lit(0)).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)  # at most _TICKS + 1 rows
        over = ticks.withColumn("upto", F.sum("mass").over(line)).where(F.col("upto") > total - spent).orderBy("tick").first()
        if over is None:  # everything fits
            last = copies.agg(F.max("at").alias("at")).first()["at"]
            return None if last is None else tuple(last)
        spent += over["upto"] - over["mass"]
        near = near.where(tick == over["tick"])
        if over["n"] <= TICK_ROWS or over["tick"] == top or width < 1e-13:
            break
        low, width, cells = low + over["tick"] * width, width / 1024, 1024
        top = 2 * cells
    order = Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    fits = near.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= total - spent).agg(F.max("at").alias("at")).first()["at"]
    if fits is None:  # the budget ends with what comes before this tick
        first = near.agg(F.min("at").alias("at")).first()["at"]
        fits = copies.where(F.col("at") < F.struct(*[F.lit(x).alias(c) for c, x in zip("fnskzd", first)])).agg(F.max("at").alias("at")).first()["at"]
    return None if fits is None else tuple(fits)


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The documents of the mix themselves, each as often as it is taken.

    All columns of ``docs``, in ranges of ascending first finish time.  Rows
    of one id, text and source stand in for each other: the first one found is
    repeated as often as all of them are taken.
    """
    per = mix(docs, weights, epochs).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("key").alias("_key"))
    plan = materialize(per.agg(F.sum("copies").alias("_copies"), F.min("finish").alias("_finish"), (F.count("*") > 1).alias("_again")).where("_copies > 0"), "mix-plan")
    keyed = docs.withColumn("_k", shuffle_key())
    rows = keyed.join(plan, keyed["doc_id"].eqNullSafe(plan["_id"]) & keyed["source"].eqNullSafe(plan["_source"]) & (keyed["_k"] == plan["_key"]))
    if not plan.where("_again").isEmpty():
        rows = rows.where("not _again").unionByName(rows.where("_again").dropDuplicates(["_id", "_source", "_key"]))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    # By construction equal spans of finish time hold near-equal numbers of tokens, so ranges need no sampling.
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    span = F.least(F.lit(n - 1), F.floor(F.col("_finish") * n)).cast("int")
    return rows.repartitionById(n, span).sortWithinPartitions("_finish", "_key", "_copy").select(*[F.col(f"`{c}`") for c in docs.columns])

"""Score tables derived from ``events``, in Spark and as SQL for the oracle.

They exercise the operators on a second engine; they are not music.  A user is
a score, an event a note; change points follow from the score's number and
hold the awkward cases: changes off the grid, two on one tick, a first tempo
after tick 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOTES_SQL = """notes AS (SELECT CAST(user_id AS BIGINT) score_id, CAST(event_id % 2 AS BIGINT) track_ord,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) note_ord,
 CAST(40 + event_id % 45 AS BIGINT) pitch,
 CAST(240 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS BIGINT) start_tick,
 CAST(120 * (1 + event_id % 8) AS BIGINT) duration, CAST(1 + event_id % 127 AS BIGINT) velocity,
 CAST(event_id % 3 AS BIGINT) voice FROM events)"""
LEN_SQL = "len AS (SELECT score_id, CAST(max(start_tick + duration) AS BIGINT) length FROM notes GROUP BY 1)"
TS_SQL = """ts AS (
 SELECT score_id, 0 ord, CAST(0 AS BIGINT) tick, CASE score_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 6 END numerator, CASE score_id % 3 WHEN 2 THEN 8 ELSE 4 END denominator FROM len
 UNION ALL SELECT score_id, 1, CAST(3000 + score_id % 7 * 240 AS BIGINT), CASE score_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 7 ELSE 5 END, CASE score_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 8 ELSE 4 END FROM len
 UNION ALL SELECT score_id, 2, CAST(3000 + score_id % 7 * 240 AS BIGINT), 3, 4 FROM len WHERE score_id % 5 = 0)"""
KS_SQL = """ks AS (
 SELECT score_id, 0 ord, CAST(0 AS BIGINT) tick, CAST(score_id % 15 - 7 AS INTEGER) fifths, CASE WHEN score_id % 2 = 0 THEN 'major' ELSE 'minor' END AS mode FROM len
 UNION ALL SELECT score_id, 1, CAST(4000 + score_id % 3 * 100 AS BIGINT), CAST((score_id * 3) % 15 - 7 AS INTEGER), 'major' FROM len)"""
TP_SQL = """tp AS (
 SELECT score_id, 0 ord, CAST(score_id % 2 * 480 AS BIGINT) tick, CAST(90 + score_id % 60 AS DOUBLE) bpm FROM len
 UNION ALL SELECT score_id, 1, CAST(2400 AS BIGINT), CAST(60 + score_id % 90 AS DOUBLE) FROM len)"""
PC_SQL = """printed AS (
 SELECT score_id, CAST(k AS INTEGER) ord, CAST(k * (500 + score_id % 5 * 180) AS BIGINT) tick,
  CASE CAST((score_id + k) % 7 AS INTEGER) WHEN 0 THEN 'C' WHEN 1 THEN 'Dm' WHEN 2 THEN 'G7' WHEN 3 THEN 'Bb' WHEN 4 THEN 'F#m' WHEN 5 THEN 'Am7' ELSE 'Eb' END AS text,
  CASE CAST((score_id + k) % 7 AS INTEGER) WHEN 0 THEN 'C' WHEN 1 THEN 'D' WHEN 2 THEN 'G' WHEN 3 THEN 'Bb' WHEN 4 THEN 'F#' WHEN 5 THEN 'A' ELSE 'Eb' END AS root,
  CASE CAST((score_id + k) % 7 AS INTEGER) WHEN 1 THEN 'm' WHEN 2 THEN '7' WHEN 4 THEN 'm' WHEN 5 THEN 'm7' ELSE '' END AS quality,
  CAST((score_id * 7 + k * 13) % 100 AS DOUBLE) / 100 AS confidence, (score_id + k) % 3 = 0 AS repaired
 FROM len, (SELECT unnest(range(0, 6)) k) ks6 WHERE score_id % 4 <> 3)"""
#: Measures by recursion: a signature counts from the first measure that starts at or after it.
MS_SQL = """ms AS (
 SELECT l.score_id, CAST(0 AS BIGINT) AS idx, CAST(0 AS DOUBLE) AS s, l.length AS total,
  (SELECT arg_max(numerator, ord) FROM ts WHERE ts.score_id = l.score_id AND ts.tick <= 0) AS num,
  (SELECT arg_max(denominator, ord) FROM ts WHERE ts.score_id = l.score_id AND ts.tick <= 0) AS den FROM len l
 UNION ALL
 SELECT n.score_id, n.idx + 1, n.e, n.total,
  (SELECT arg_max(numerator, ord) FROM ts WHERE ts.score_id = n.score_id AND ts.tick <= n.e),
  (SELECT arg_max(denominator, ord) FROM ts WHERE ts.score_id = n.score_id AND ts.tick <= n.e)
 FROM (SELECT score_id, idx, total, s + 1920.0 * num / den AS e FROM ms) n WHERE n.e < n.total)"""
BARS_SQL = "bars AS (SELECT score_id, idx, s AS start_tick, s + 1920.0 * num / den AS end_tick, num AS numerator, den AS denominator FROM ms)"
#: Windows of one pulse.
WIN_SQL = """win AS (SELECT score_id, idx AS measure, CAST(w AS BIGINT) w, start_tick + w * step AS w_start, least(start_tick + (w + 1) * step, end_tick) AS w_end
 FROM (SELECT *, least(480.0, 1920.0 / denominator) AS step FROM bars) b, (SELECT unnest(range(0, 64)) w) r WHERE start_tick + w * step < end_tick - 1e-6)"""


def with_sql(body: str, *parts: str) -> str:
    named = {"notes": NOTES_SQL, "len": LEN_SQL, "ts": TS_SQL, "ks": KS_SQL, "tp": TP_SQL, "printed": PC_SQL, "ms": MS_SQL, "bars": BARS_SQL, "win": WIN_SQL}
    needs = {"len": ["notes"], "ts": ["len"], "ks": ["len"], "tp": ["len"], "printed": ["len"], "ms": ["ts"], "bars": ["ms"], "win": ["bars"]}
    order: list[str] = []

    def add(p: str) -> None:
        for q in needs.get(p, []):
            add(q)
        if p not in order:
            order.append(p)

    for p in parts:
        add(p)
    return "WITH RECURSIVE " + ",\n".join(named[p] for p in order) + "\n" + body


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = e.select("user_id", "event_id", n.cast("long").alias("n"))
    i = F.col("event_id")
    return rows.select(
        F.col("user_id").cast("long").alias("score_id"), (i % 2).cast("long").alias("track_ord"), F.col("n").alias("note_ord"),
        (i % 45 + 40).cast("long").alias("pitch"), (F.col("n") * 240).alias("start_tick"), ((i % 8 + 1) * 120).cast("long").alias("duration"),
        (i % 127 + 1).cast("long").alias("velocity"), (i % 3).cast("long").alias("voice"),
    )


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("score_id")).distinct()


def _points(scores: DataFrame, items: list) -> DataFrame:
    return scores.select("score_id", F.explode(F.array_compact(F.array(*items))).alias("x")).select("score_id", "x.*")


def time_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score_id")
    later = (s % 7 * 240 + 3000).cast("long")
    item = lambda o, t, n, d: F.struct(F.lit(o).alias("ord"), t.alias("tick"), n.cast("int").alias("numerator"), d.cast("int").alias("denominator"))
    return _points(_scores(spark, sf_dir), [
        item(0, F.lit(0).cast("long"), F.when(s % 3 == 0, 4).when(s % 3 == 1, 3).otherwise(6), F.when(s % 3 == 2, 8).otherwise(4)),
        item(1, later, F.when(s % 4 == 0, 2).when(s % 4 == 1, 7).otherwise(5), F.when(s % 4 == 0, 2).when(s % 4 == 1, 8).otherwise(4)),
        F.when(s % 5 == 0, item(2, later, F.lit(3), F.lit(4))),
    ])


def key_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score_id")
    item = lambda o, t, f, m: F.struct(F.lit(o).alias("ord"), t.cast("long").alias("tick"), f.cast("int").alias("fifths"), m.alias("mode"))
    return _points(_scores(spark, sf_dir), [item(0, F.lit(0), s % 15 - 7, F.when(s % 2 == 0, "major").otherwise("minor")), item(1, s % 3 * 100 + 4000, (s * 3) % 15 - 7, F.lit("major"))])


def tempos(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score_id")
    item = lambda o, t, b: F.struct(F.lit(o).alias("ord"), t.cast("long").alias("tick"), b.cast("double").alias("bpm"))
    return _points(_scores(spark, sf_dir), [item(0, s % 2 * 480, s % 60 + 90), item(1, F.lit(2400), s % 90 + 60)])


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("score_id"), F.col("k")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), ((s + k) % 7 + 1).cast("int"))
    rows = _scores(spark, sf_dir).where(s % 4 != 3).select("score_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    return rows.select(
        "score_id", k.alias("ord"), (k * (s % 5 * 180 + 500)).cast("long").alias("tick"),
        pick("C", "Dm", "G7", "Bb", "F#m", "Am7", "Eb").alias("text"), pick("C", "D", "G", "Bb", "F#", "A", "Eb").alias("root"),
        pick("", "m", "7", "", "m", "m7", "").alias("quality"), (((s * 7 + k * 13) % 100).cast("double") / 100).alias("confidence"),
        ((s + k) % 3 == 0).alias("repaired"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.timeline import measures, score_lengths

    return measures(score_lengths(notes(spark, sf_dir)), time_signatures(spark, sf_dir), most=None)


def beats(spark: SparkSession, sf_dir: str, resolution: str = "beat") -> DataFrame:
    from ..operators.timeline import windows

    return windows(bars(spark, sf_dir), resolution)

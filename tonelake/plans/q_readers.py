"""Queries on chord symbols of a reader, with systems derived from ``events``: eight notes a system, four a measure.

The reader here stands for a service: it answers from a system's payload, fails
for some, and names measures that are not there and words that are no chords.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import readers
from . import derived as d
from .registry import query

_WORDS = ("C", "Dm7", "no chord", "G7", "Bb")


def _reader(payload: bytes, measures: int) -> list:
    total = int(payload)
    if total % 5 == 0:
        raise readers.ReaderError("rate", "too many calls")
    return [(total % 4, total % 7 / 2, _WORDS[total % 5]), (1, None, _WORDS[total // 2 % 5]), (1, 1, _WORDS[total // 2 % 5])]


def _read(spark, sf) -> readers.Read:
    n = F.expr("max(note_ord % 8) DIV 4 + 1")
    cell = lambda k: F.struct((F.col("system") * 2 + k).alias("measure"), ((F.col("system") * 2 + k) * 960).alias("tick"), F.lit(960).alias("length"), F.lit(240).alias("beat_ticks"))
    systems = d.notes(spark, sf).groupBy("score_id", F.expr("note_ord DIV 8").alias("system")).agg(F.sum("pitch").cast("string").cast("binary").alias("payload"), n.alias("n"))
    systems = systems.select("score_id", "system", "payload", ((F.col("score_id") + F.col("system")) % 3 == 0).alias("text_layer"), F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), cell).alias("cells"))
    earlier = d.printed(spark, sf).select("score_id", F.expr("tick DIV 960").alias("measure"), "tick", "text", "confidence")
    return readers.read_chords(systems, earlier, _reader)


_SQL = """systems AS (SELECT score_id, note_ord // 8 AS system, CAST(sum(pitch) AS BIGINT) AS m, max(note_ord % 8) // 4 + 1 AS n FROM notes GROUP BY 1, 2),
sourced AS (SELECT *, CASE WHEN (score_id + system) % 3 = 0 THEN 'text' WHEN m % 5 = 0 THEN 'earlier' ELSE 'reader' END AS source FROM systems),
words AS (SELECT ['C', 'Dm7', 'no chord', 'G7', 'Bb'] AS w),
answers AS (SELECT score_id, system, n, m % 4 AS k, m % 7 / 2.0 AS beat, w[m % 5 + 1] AS text FROM sourced, words WHERE source = 'reader'
 UNION ALL SELECT score_id, system, n, 1, 1, w[m // 2 % 5 + 1] FROM sourced, words WHERE source = 'reader'),
placed AS (SELECT DISTINCT score_id, system * 2 + k - 1 AS measure, (system * 2 + k - 1) * 960 + 240 * CAST(least(3, greatest(0, floor(beat - 0.5))) AS BIGINT) AS tick, text FROM answers WHERE k BETWEEN 1 AND n AND text <> 'no chord')
"""


def _sql(body: str, *parts: str) -> str:
    return d.with_sql("\x00", *parts).replace("\n\x00", ",\n" + _SQL + body)


@query("c19_injected_reader", _sql("""SELECT score_id, CAST(measure AS BIGINT) AS measure, CAST(tick AS BIGINT) AS tick, text, CAST(0.95 AS DOUBLE) AS confidence, 'reader' AS source FROM placed
UNION ALL SELECT p.score_id, p.tick // 960, p.tick, p.text, p.confidence, CASE WHEN s.source = 'text' THEN 'text' ELSE 'earlier' END FROM printed p
 LEFT JOIN sourced s ON s.score_id = p.score_id AND s.system = p.tick // 1920 AND p.tick // 960 < s.system * 2 + s.n WHERE coalesce(s.source, '') <> 'reader'""", "printed"))
def c19(spark, sf):
    """Answers of the reader over earlier symbols, with where each comes from."""
    return _read(spark, sf).chords


@query("c24_chord_sources", _sql("""SELECT score_id, CAST(system AS INTEGER) AS system, source, CASE WHEN source = 'earlier' THEN 'rate' END AS failure,
 CASE WHEN source = 'earlier' THEN 'The reader could not read the chord symbols' || CASE WHEN count(*) FILTER (source = 'reader') OVER s > 0 THEN ' for ' || count(*) FILTER (source = 'earlier') OVER s || ' of ' || count(*) FILTER (source <> 'text') OVER s || ' systems' ELSE '' END
  || ': too many calls. The chord labels read before were used' || CASE WHEN count(*) FILTER (source = 'reader') OVER s > 0 THEN ' for those systems' ELSE '' END || '.' END AS warning
 FROM sourced WINDOW s AS (PARTITION BY score_id)""", "notes"))
def c24(spark, sf):
    """Each system's source, how it failed if it did, and its score's warning."""
    read = _read(spark, sf)
    told = read.systems.join(read.warnings.withColumnRenamed("message", "warning"), "score_id", "left")
    return told.select("score_id", "system", "source", "failure", F.when(F.col("failure").isNotNull(), F.col("warning")).alias("warning"))

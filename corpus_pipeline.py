"""A corpus pipeline of four stages over ``documents``.

Language identification drops what it rejects, near-duplicate removal keeps
one document of each class, mixing takes documents by source weights, and
packing turns the mix into sequences.  Each stage's result is written to the
shared folder and read back as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm import language, mixing, neardup, packing
from tonelake.llm.common import materialize, table

#: Texts whose language scores less than this are rejected, as are those without letters.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.

    Rejects null texts, texts without letters and those whose best language
    has a share below ``LEAST_SCORE``.  Where no row is labelled, nothing can
    be rejected for its language, so all texts with letters stay.  Only texts
    go to Python; all columns stay as they are, whatever their type or name.
    """
    langs, net = language.fit(docs)
    if net is None:
        return docs.where(language.has_letter(F.coalesce("text", F.lit(""))))
    names = (f"_language_{uuid.uuid4().hex}", f"_share_{uuid.uuid4().hex}")  # no column of the input is called so
    judged = language.predict(docs, langs, net, keep=tuple(docs.columns), names=names)
    return judged.where((F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE)).drop(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    return neardup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights; a document is repeated as often as it is taken."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mix", mix), ("packing", pack)]

#: SQL can express neither the network nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of ``documents`` after all stages.

    Rows with null or empty texts go in the first stage, repeated rows and
    near copies in the second; an empty table gives no rows; ids, null ones
    among them, stay exact; other columns travel along unread.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs

"""The corpus pipeline: documents through five stages, each written and read again.

Order: quality classifier, line dedup, near-dedup, personal data, packing. All stages but
the last return the columns of documents, and further ones of any name with them. Every
stage takes null and empty texts, null ids, repeated rows and an empty table, which stays
empty; what each does with them is in its docstring and in its operator's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.llm.common import SPACES, documents, materialize
from loglake.llm.line_dedup import drop_repeated_lines
from loglake.llm.minhash import near_dedup
from loglake.llm.packing import pack
from loglake.llm.pii import redact
from loglake.llm.quality_classifier import quality_classifier
from loglake.session import prepare


def classify(spark, docs, sf_dir):
    """Rejected documents go. A null or empty text is judged as a text without words; rows
    that share an id stay if one of them is kept."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    verdict = quality_classifier(docs, labels).filter("kept").select(F.col("doc_id").alias("_id"))
    return docs.join(verdict, docs["doc_id"].eqNullSafe(verdict["_id"]), "left_semi")


def dedup_lines(spark, docs, sf_dir):
    """Lines that repeat an earlier one go, and documents of which no word is left; null and
    blank texts have none. Of equal lines the first by id and place stays; a row without id
    keeps its lines; rows that share an id lose the lines of all of them."""
    words = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)) != ""
    out = drop_repeated_lines(docs.filter(words)).filter(words)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def dedup_near(spark, docs, sf_dir):
    """One document of each near-duplicate group stays, the one of the least id; a row
    without id or without words is in no group and stays; rows that share an id stay
    together."""
    kept = near_dedup(docs).filter("kept").select(F.col("doc_id").alias("_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def redact_pii(spark, docs, sf_dir):
    """Personal data and secrets are replaced by their kinds, row by row; a null text stays."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark, docs, sf_dir):
    """The pieces of all documents in sequences; null and empty texts are one end id."""
    return pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: The classifier and the boosted trees are fitted models: not SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs

"""A training corpus in five stages: language identification, quality, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and reads it
again as the next stage's docs.  All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import _shared, bestfit_packing, language_id, line_quality, partenum_join, secret_scan
from lociframe.llm.queries import table, tokenizer_file

#: A document of a lower score goes.
LEAST_QUALITY = 0.3
#: Near duplicates share word n-grams of this length, by this Jaccard similarity (in hundredths).
WORDS, SIMILAR = 5, 80
#: Ids to drop up to this many are broadcast (8 bytes each); beyond it, a join by id.
BROADCAST_IDS = 1_000_000
MARK = "[SECRET]"
#: The stages learn, match and pack; SQL does not express them.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unknown: without a letter, or below the calibrated threshold."""
    model = language_id.fit_language(docs)
    names = tuple(_shared.unused(n, docs.columns) for n in ("lang_pred", "score", "accepted"))
    found = language_id.identify(docs, model, keep=docs.columns, names=names)
    return found.filter(F.col(names[2])).drop(*names)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose lines are mostly bad."""
    field = line_quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    name = _shared.unused("score", docs.columns)
    return line_quality.score_quality(docs, field, keep=docs.columns, name=name).filter(F.col(name) >= LEAST_QUALITY).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays.  Where ids are null or repeated, rows are
    numbered, and the first row stays: only rows that are near duplicates of another go."""
    key = "doc_id"
    if docs.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).head(1):
        key = _shared.unused("row", docs.columns)
        docs = _shared.written(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows")
    groups = partenum_join.jaccard_components(docs, WORDS, SIMILAR, 100, id_col=key)
    gone = _shared.written(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(key)), "pipeline-gone")
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti").select(*map(_shared.quoted, docs.columns))
    return left if key == "doc_id" else left.drop(key)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by MARK; all documents stay."""
    name = _shared.unused("found", docs.columns)
    rows = secret_scan.masked(secret_scan.scan_secrets(docs, keep=docs.columns, name=name), "text", MARK, name).drop(name)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _shared.written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

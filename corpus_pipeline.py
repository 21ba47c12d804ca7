"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, personal numbers get
pseudonyms, and what remains is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.

Edge cases: a null text is kept as a clean document without words, keeps its null, and is packed as its closing id alone;
null and repeated ids are rows like others; repeated rows are copies, of which one stays; documents without words all
stay; other columns pass through whatever their names, ``severity``, ``p_toxic``, ``grade`` and ``__row`` too; an empty
table gives empty stages. A very long text is one row in each stage and must fit its task, as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.cluster import ship
from loomtext.llm import bpe, jaccard_join, packing, pii, toxicity
from loomtext.llm.queries import PII_KEY
from loomtext.llm.store import Store

#: Near-duplicates here share five-word shingles with a similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, doesn't find toxic."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = [f"c{i}" for i in range(len(docs.columns))]  # no column is taken for a score
    scored = toxicity.score(docs.toDF(*own), model, text=own[docs.columns.index("text")])
    return scored.where(F.col("p_toxic") < toxicity.REJECT).select(*own).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each component, null ids last; rows without words all stay.

    Ids may be null or repeated, so rows are joined by a number of their own, written with them as it must not change.
    """
    ship(spark)
    row = "__row"
    while row in docs.columns:
        row += "_"
    rows = Store(spark, "near").cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard_join.join(rows, key=row, k=WORDS, percent=PERCENT).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row)
    kept = rows.select(row, "doc_id").join(found, row).groupBy("component_id").agg(first).select(row)
    gone = rows.select(row).join(kept, row, "left_anti")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def hide_numbers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in the texts; ``n_chars`` follows, though formats keep their length but for octets."""
    out = pii.pseudonymize(docs, PII_KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: each is a sequence of its own, with its ids."""
    ship(spark)
    return packing.pack(docs, bpe.default_vocabulary())


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("pii", hide_numbers), ("packing", pack)]
#: SQL can't express the model nor the vocabulary; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store.cut(docs, name)
            store.only(docs)
    return docs

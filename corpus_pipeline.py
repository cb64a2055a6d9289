"""A corpus pipeline of four stages over ``documents``; each works on all rows its predecessor kept.

All stages but the last return the columns of ``documents``. Rows with null ids or texts pass through each stage by its
operator's rules: they are neither toxic, nor near copies of other texts, nor contaminated, unless their text says so. Decisions
about rows are joined back by a key of id and text, as ids can be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm import decontaminate, jaccard, pieces, toxicity
from tessellar.llm.shared import drop, free, table, written


def free_name(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as it takes not to be a column of ``docs``."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key, equal for rows that share id and text (both nulls of their own), and that column's name."""
    key = free_name(docs, "__row")
    return docs.withColumn(key, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")), key


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go. The classifier learns from the labelled documents among its input.

    Null and empty texts are scored by the bias alone; repeated rows go or stay together; without labels or documents nothing goes."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return toxicity.score(docs, model, score).filter((F.col(score) < 0.5) | (not len(model[0]))).drop(score)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard of 0.8 or more) the document with the smallest doc_id stays.

    Null ids count as larger than all others; of different texts under the smallest id one stays. Documents without words aren't
    copies of each other and stay; of rows that repeat an id and its text one stays."""
    rows, key = keyed(docs)
    groups = jaccard.jaccard_components(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    known = groups.distinct().join(rows.select(key, "doc_id").distinct(), key)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("first")
    stay = known.groupBy("component_id").agg(first).select(f"first.{key}")
    # the key among the columns: texts stay where the join has put them, and are shuffled once
    return rows.join(stay, key, "left_semi").dropDuplicates([key, "doc_id", "text"]).select(docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, also an edited one, go.

    Null and empty texts stay; of rows that share an id only those whose own text holds a passage go; without items or documents nothing goes."""
    rows, key = keyed(docs)
    hits = decontaminate.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(hits.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_pieces of every document, with the text that the ids decode to.

    A null or empty text has no ids and decodes to the empty one; repeated rows stay; no document gives no row."""
    model = pieces.default_model()
    return pieces.encode(docs, model, ["doc_id"], finish=pieces.decoded(model))


STAGES = [("toxicity", toxic_out), ("near_copies", one_of_near_copies), ("decontamination", uncontaminated), ("pieces", tokenized)]

#: No stage can be expressed in SQL (a fitted classifier, exact set joins with components, alignment, a piece lattice).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
        free(spark)
    return STAGES[-1][1](spark, docs, sf_dir)

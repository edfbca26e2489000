"""From raw documents to encoded training data: five stages, each over all that the stage before it kept.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, and all but
the last return the columns of ``docs``. ``run`` writes each stage's rows to the shared folder and reads them
again for the next. No stage but the last has SQL that gives the same rows (a trained model, hashed sketches),
so ``ORACLE_SQL`` is None and the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm._common import materialize, packed, quoted, row_key, table
from auditlake.llm.bpe import encode_documents
from auditlake.llm.line_dedup import dedup_lines
from auditlake.llm.mixing import mix
from auditlake.llm.near_dedup import near_duplicates
from auditlake.llm.toxicity import score, toxicity_model

ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """All columns of each row as ``all``, 128 bits of key of its id and text, and id and key as ``known``, by which rows are told apart."""
    a, b = row_key("doc_id", "text")
    row = F.struct(F.col("doc_id").alias("id"), a.alias("a"), b.alias("b"))
    return docs.select(packed(docs).alias("all"), a.alias("a"), b.alias("b"), row.alias("known"), "text", "source")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the model learns from the labels of these documents.

    Null and empty texts are scored as texts without words; rows that repeat are scored alike. Without labelled rows nothing is dropped.
    """
    rows = docs.select(packed(docs).alias("all"), "text")
    return score(rows, toxicity_model(spark, sf_dir, docs), id_column="all").where("score < 0.5").select("all.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat an earlier one; every document stays, n_chars is of what is left (null of a null text)."""
    kept = dedup_lines(docs, keep=docs.columns)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*[quoted(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (and key) of each class of near copies; of rows that repeat id and text one.

    All texts without words are one class. A null id is smaller than any other. Of no documents none are left.
    """
    keyed = _keyed(docs)
    classes = near_duplicates(keyed, id_column="known")
    stay = materialize(classes.where("known = class_id").select("known.a", "known.b").distinct(), "stay")
    return keyed.join(stay, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]).select("all.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded to whole documents: none to three times.

    Documents without words take no part in a mix of words, and go. Of no documents none are left.
    """
    keyed = _keyed(docs)
    taken = mix(keyed, id_column="known")[0].groupBy("known.a", "known.b").agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("times"), F.count(F.lit(1)).alias("rows"))
    times = materialize(taken.select("a", "b", F.floor(F.col("times") * F.col("rows") + 0.5).cast("int").alias("times")).where("times > 0"), "times")
    once = keyed.join(times, ["a", "b"]).dropDuplicates(["a", "b"])
    return once.select("all", F.explode(F.sequence(F.lit(1), F.col("times")))).select("all.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and what they decode to, as digests; a null text counts as empty and has no tokens, and without documents there are no rows."""
    return encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

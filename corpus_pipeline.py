"""From raw documents to packed training sequences, in five stages that each work on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the columns of documents, of any
type; columns that stages add for a while avoid the names that are taken.  Null and empty texts are not toxic, have no
language (rejected there), and so never reach the later stages; very long ones pass whole.  Of repeated rows the first
two stages keep or drop all, the third keeps one.  An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import common as C
from larkspur.llm import language_id, ngram_join, packing, pii, toxicity
from larkspur.llm.token_counts import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic; it learns from the labels outside the held-out fold."""
    model = toxicity.learn(docs, C.table(spark, sf_dir, "labels"), lambda i: ~C.held_out(i))
    out = C.fresh(docs.columns, "_score", "_predicted")
    return toxicity.score(docs, model, out=out).where(F.col(out[1]) == 0).select(docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lie near a centroid of a language; lang stays as it came."""
    model = language_id.learn(docs, language_id.not_held_out)
    out = C.fresh(docs.columns, "_lang", "_score", "_rejected")
    return language_id.identify(docs, model, out=out).where(~F.col(out[2])).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles (Jaccard from 0.8 on), directly or by others, the one with the least id.

    Of rows that share an id, one stays: the first by text.  Rows without an id stay."""
    groups = C.materialise(ngram_join.similar_groups(docs), "groups")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    gone = C.materialise(gone, "gone")
    may_go = C.may_be_among(gone)
    # most rows surely stay and need no shuffle
    doubtful = docs.where(may_go(F.col("doc_id"))).join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    kept = docs.where(~may_go(F.col("doc_id"))).unionByName(doubtful)
    repeated = C.materialise(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    (name,) = C.fresh(docs.columns, "_number")
    ties = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]  # maps have no order, their text has
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", *ties))
    some = kept.join(repeated, "doc_id", "left_semi").withColumn(name, number).where(F.col(name) == 1).select(docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(some)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; n_chars follows."""
    return pii.redact(docs, count_col="n_chars" if "n_chars" in docs.columns else None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("PII", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the fitted stages nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one keeps is written and read again by the next."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def store(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Writes what ``run`` gives as Parquet, then deletes every intermediate of this session."""
    run(spark, sf_dir).write.parquet(path)
    C.release(spark)

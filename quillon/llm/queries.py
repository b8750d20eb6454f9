"""Queries of this package's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import cut, spread, table
from .distinctive import TF_IDF, most_distinctive, term_scores
from .frequency import marked_terms
from .leak import leaked
from .oneform import same_looking_pairs, unify
from .neardup import Likeness, groups, near_duplicates, near_pairs
from .packing import fill, pack, token_sizes
from .reading import bands, reading_levels
from .wrapper import clean_markup, template_nodes


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns))


def p1_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(_documents(spark, sf_dir, "title", "text"), ["title", "text"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_term_counts(spark, sf_dir).where("mark IS NOT NULL").select("term", "mark")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, whose host is their source, and articles, whose host is their dump."""
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("source").alias("host"), "text")
    articles = table(spark, sf_dir, "articles").select(F.lit("article").alias("kind"), F.col("revision_id").alias("id"), F.lit("articles").alias("host"), "text")
    return spread(docs.unionByName(articles))


def p2_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_markup(_records(spark, sf_dir))


def p2_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What wrapper induction found constant, by host."""
    return template_nodes(_records(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_clean_text(spark, sf_dir).where("pieces > 0").select("record_kind", "record_id").distinct()


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = term_scores(_documents(spark, sf_dir, "title", "text"), "doc_id", ["title", "text"])
    return scored.withColumn("score", F.round("score", 6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the statement's weight: the operator's without saturation and length normalisation."""
    return most_distinctive(_documents(spark, sf_dir, "title", "text"), "doc_id", ["title", "text"], weighting=TF_IDF).select("doc_id", "term")


def p3_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by relevance weighting with saturation and length normalisation."""
    best = most_distinctive(_documents(spark, sf_dir, "title", "text"), "doc_id", ["title", "text"])
    return best.withColumnRenamed("weight", "score")


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify(_documents(spark, sf_dir, "title", "text"), ["title", "text"]).select("doc_id", "title_form", "text_form")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking_pairs(_documents(spark, sf_dir, "title", "text"), "doc_id", ["title", "text"])


#: What a reworked copy is by the statement of the problem.
REWORKED = Likeness(shingle=3, threshold=0.7, least_terms=40)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(near_duplicates(_documents(spark, sf_dir, "title", "text"), "doc_id", ["title", "text"], REWORKED), "doc_id")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(near_duplicates(_documents(spark, sf_dir, "title", "text"), "doc_id", ["title", "text"]), "doc_id").withColumnRenamed("group", "group_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_sizes(_documents(spark, sf_dir, "text"), "doc_id", "text"), "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on the containers: what must be 0, and whether little is unused."""
    sizes = cut(token_sizes(_documents(spark, sf_dir, "text"), "doc_id", "text"))
    return fill(sizes, pack(sizes, "doc_id"), "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(token_sizes(_documents(spark, sf_dir, "text"), "doc_id", "text"), "doc_id")
    # only a text that exceeds a container has a second part
    return packed.where("part = 1").select("doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(_documents(spark, sf_dir, "text"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def _levels(spark: SparkSession, sf_dir: str, judged: bool = False):
    return reading_levels(_documents(spark, sf_dir, "text", "lang", "source"), table(spark, sf_dir, "reading_labels"), "doc_id", "text", judged)


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, _ = _levels(spark, sf_dir)
    return levels.select("doc_id", F.round("level", 4).alias("level"))


def p9_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the grades on sources held out of training and calibration, and that of the mean."""
    _, known = _levels(spark, sf_dir, judged=True)
    return spark.createDataFrame(known.folds, "fold int, documents int, mean_error double, error_of_mean double, correlation double")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, known = _levels(spark, sf_dir)
    return bands(levels, "doc_id", graded=known.model is not None).distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_term_counts": p1_term_counts,
    "p2_found": p2_found,
    "p2_clean_text": p2_clean_text,
    "p2_template": p2_template,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p3_best": p3_best,
    "p5_found": p5_found,
    "p5_forms": p5_forms,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
    "p9_held_out": p9_held_out,
}

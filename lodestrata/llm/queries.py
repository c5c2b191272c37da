"""Queries of the operators in this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import formula_text
from lodestrata.llm.collapse import assign_keepers
from lodestrata.llm.leaks import find_leaks
from lodestrata.llm.mixing import mix
from lodestrata.llm.near_duplicates import class_of_each, expanded
from lodestrata.llm.reading import reading_levels
from lodestrata.llm.top_items import top_n


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _formulas(spark: SparkSession, sf: str) -> DataFrame:
    both = [_table(spark, sf, t).select(F.col("rec_id").alias("id"), F.col("formula").alias("text")) for t in ("final_pool", "aa_trajectory")]
    return both[0].unionByName(both[1])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = expanded(_formulas(spark, sf), formula_text.words)
    return found.select(F.col("id_a").alias("rec_id_a"), F.col("id_b").alias("rec_id_b"))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record with the class of its bag and the class's number of links to other classes."""
    found = class_of_each(_formulas(spark, sf), formula_text.words)
    return found.select(F.col("id").alias("rec_id"), F.col("rep").alias("class_id"), "n_links")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return top_n(_table(spark, sf, "final_pool"), ["method", "seed"], "effective_fitness", "rec_id", 5).select("rec_id")


def p4_top(spark: SparkSession, sf: str) -> DataFrame:
    return top_n(_table(spark, sf, "final_pool"), ["method", "seed"], "effective_fitness", "rec_id", 5)


def _writings(spark: SparkSession, sf: str) -> DataFrame:
    pool = _table(spark, sf, "final_pool").select(F.lit(0).alias("part"), F.col("rec_id").alias("id"), F.col("formula").alias("text"))
    return pool.unionByName(_table(spark, sf, "aa_trajectory").select(F.lit(1).alias("part"), F.col("rec_id").alias("id"), F.col("seed_formula").alias("text")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = assign_keepers(_writings(spark, sf), formula_text.canonical, repeats_only=True)
    return found.filter("id > keep_id").select("keep_id", F.col("id").alias("copy_id"))


def p5_copies(spark: SparkSession, sf: str) -> DataFrame:
    found = assign_keepers(_writings(spark, sf), formula_text.canonical)
    return found.filter("id = keep_id").select(F.when(F.col("part") == 0, "final_pool").otherwise("aa_trajectory").alias("tab"), "keep_id", "n_copies")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    documents = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    items = _table(spark, sf, "eval_items").select("item_id", F.explode(F.array(F.struct(F.lit("passage").alias("side"), F.col("passage").alias("text")), F.struct(F.lit("ref_text").alias("side"), F.col("ref_text").alias("text")))).alias("s")).select("item_id", "s.*")
    return find_leaks(documents, items)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_report(spark, sf).filter("exact_windows > 0").select("doc_id", "item_id").distinct()


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))[1]


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading_levels(_table(spark, sf, "documents"), _table(spark, sf, "reading_labels"), "lang")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_levels(spark, sf).filter("level = 4").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_classes": p2_classes, "p4_found": p4_found, "p4_top": p4_top, "p5_found": p5_found, "p5_copies": p5_copies, "p6_found": p6_found, "p6_report": p6_report, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_levels": p8_levels}

_P4 = """
SELECT {columns} FROM (
  SELECT method, seed, effective_fitness, rec_id,
         row_number() OVER (PARTITION BY method, seed ORDER BY effective_fitness DESC, rec_id) AS rn
  FROM final_pool
  WHERE method IS NOT NULL AND seed IS NOT NULL AND effective_fitness IS NOT NULL AND NOT isnan(effective_fitness))
WHERE rn <= 5"""
ORACLE: dict[str, str] = {"p4_found": _P4.format(columns="rec_id"), "p4_top": _P4.format(columns="method, seed, effective_fitness, rec_id")}

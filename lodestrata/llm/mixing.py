"""Mixing of sources to target weights, with sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.storage import materialize, skew_join

VOCABULARY = "byte_bpe_50k.tiktoken"


def _count_tokens(vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(coder.encode_ordinary(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return run


def fill(wanted: np.ndarray, most: np.ndarray, total: float) -> np.ndarray:
    """Sizes in proportion to ``wanted``, none above ``most``, that reach ``total`` if that is possible.

    What a capped source can't give goes to the others in proportion to their own shares.
    """
    size = np.zeros(len(wanted))
    open_ = (wanted > 0) & (most > 0)
    while open_.any():
        left = total - size[~open_].sum()
        part = left * wanted / wanted[open_].sum()
        full = open_ & (part >= most)
        if not full.any():
            size[open_] = part[open_]
            break
        size[full] = most[full]
        open_ &= ~full
    return np.maximum(size, 0)


def _rates(plan: pd.DataFrame) -> pd.DataFrame:
    plan = plan.sort_values("source").reset_index(drop=True)
    tokens = plan.tokens.to_numpy(float)
    size = fill(plan.target_share.fillna(0).clip(lower=0).to_numpy(float), plan.max_repeats.fillna(0).clip(lower=0).to_numpy(float) * tokens, float(plan.budget.iloc[0]))
    with np.errstate(all="ignore"):
        plan["rate"] = np.where(tokens > 0, size / tokens, 0.0)
    return plan[["plan_id", "source", "target_share", "max_repeats", "budget", "tokens", "docs", "rate"]]


def _sized(documents: DataFrame, vocabulary: str | None) -> DataFrame:
    rows = documents.filter("text is not null").select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))
    return materialize(rows.mapInArrow(_count_tokens(vocabulary), "doc_id bigint, source string, n_tokens bigint"), "tokens")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (plan_id, source, doc_id, copy_no, n_tokens) and the report of shares per plan and source.

    A plan wants ``budget_frac`` of the corpus' tokens, each source ``target_share`` of them and no document more
    than ``max_repeats`` times. A source's rate is its size in the mixture by its tokens; a document appears
    floor(rate) times, and once more if the hash of (plan, document, seed) falls below the fraction. Tokens that
    capped or absent sources can't give are spread over the plan's other sources in proportion to their targets;
    if all are capped, the mixture stays smaller. ``over_target`` reports by how much a source's share exceeds its
    target for that reason. NULL texts are left out, a NULL source is in no plan, empty texts
    have 0 tokens; an empty corpus gives an empty mixture and shares of NULL. A doc_id given twice is two documents
    with the same luck.
    """
    sized = _sized(documents, vocabulary)
    per_source = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    whole = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.count("*").alias("docs")).first()
    plans = targets.select("plan_id", "source", "target_share", "max_repeats", (F.col("budget_frac") * F.lit(float(whole.n))).alias("budget")).filter("plan_id is not null and source is not null")
    rates = plans.join(per_source, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tokens", "docs")})
    rates = materialize(rates.groupBy("plan_id").applyInPandas(_rates, "plan_id string, source string, target_share double, max_repeats int, budget double, tokens bigint, docs bigint, rate double"), "rates")
    by_source = materialize(rates.filter("rate > 0").groupBy("source").agg(F.max("docs").alias("docs"), F.collect_list(F.struct("plan_id", "rate")).alias("plans")), "by_source")
    luck = F.pmod(F.xxhash64("plan_id", "doc_id", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    chosen = skew_join(sized, by_source, ["source"], "docs", whole.docs).select("source", "doc_id", "n_tokens", F.explode("plans").alias("p")).select("source", "doc_id", "n_tokens", "p.*")
    chosen = chosen.withColumn("copies", (F.floor("rate") + (luck < F.col("rate") - F.floor("rate")).cast("int")).cast("int")).filter("copies > 0")
    got = chosen.groupBy("plan_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    report = rates.join(got, ["plan_id", "source"], "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    sums = report.groupBy("plan_id").agg(F.sum("mixed_tokens").alias("plan_tokens"))
    report = report.drop("docs").join(sums, "plan_id").withColumn("actual_share", F.when(F.col("plan_tokens") > 0, F.col("mixed_tokens") / F.col("plan_tokens")))
    report = report.withColumn("over_target", F.col("actual_share") - F.coalesce("target_share", F.lit(0.0)))
    return chosen.select("plan_id", "source", "doc_id", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"), "n_tokens"), report

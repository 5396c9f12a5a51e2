"""Batch scoring: applications through row contract, model, support, policy and reference percentile, one row each.

Rows that break the contract are kept with their reason and go to review unscored.  All of it is narrow work but the
percentile, which meets the reference cohort as distinct scores.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.operators import training as T
from loanloom.operators.application import ID, adapt_applications
from loanloom.operators.evaluation import reference_percentile
from loanloom.operators.risk import Policy, apply_policy, support_flags

# Reason codes that every research score carries.
STANDING_REASONS = ("RESEARCH_ONLY", "SELF_REPORTED_INPUT")
RESULT = [
    "model_version", "data_valid", "reason", "calibrated_pd", "risk_score", "risk_band", "credit_health_index",
    "reference_percentile", "data_quality_flags", "recommendation", "decision_status", "policy_version", "reason_codes",
]


@dataclass(frozen=True)
class Release:
    """What scoring needs of a published model.

    ``score`` adds the calibrated probability ``p`` to kept columns of valid rows; ``reference`` holds the ``p`` of
    the cohort that percentiles refer to; ``statistics`` are those of the development rows.
    """

    model_version: str
    score: Callable[[DataFrame, Sequence[str]], DataFrame]
    statistics: Mapping
    reference: DataFrame
    policy: Policy = field(default_factory=Policy)
    variant: str = "lite"
    release_ready: bool = False


def stored_release(spark: SparkSession, root: str, run_id: str | None = None, policy: Policy | None = None) -> Release:
    """The release that a training run has published under ``root``, the latest by default."""
    from loanloom.plans.training_run import RunDirectory, load_release

    fitted, calibrator, meta = load_release(spark, root, run_id)
    reference = RunDirectory(spark, root).read("reference_predictions", run_id).select("p")

    def score(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        return T.score_batch(rows, fitted, calibrator, keep)

    return Release(meta["run_id"], score, meta["support"], reference, policy or Policy(), meta["feature_set"], meta["release_ready"])


def score_applications(raw: DataFrame, release: Release) -> DataFrame:
    """One row per row of ``raw``: its id, the columns of ``RESULT`` and nothing of its input."""
    adapted = adapt_applications(raw)
    valid = adapted.where(F.col("reason").isNull()).withColumn("data_quality_flags", support_flags(release.statistics))
    scored = release.score(valid, [ID, "data_quality_flags"])
    placed = reference_percentile(scored, release.reference)
    refused = adapted.where(F.col("reason").isNotNull()).select(ID, "reason")
    everyone = placed.unionByName(refused, allowMissingColumns=True)
    flags = F.coalesce("data_quality_flags", F.array().cast("array<string>"))
    context = everyone.withColumns(
        {
            "data_quality_flags": flags, "data_valid": F.col("reason").isNull(), "supported": F.size(flags) == 0,
            "model_version": F.lit(release.model_version), "variant": F.lit(release.variant),
            "release_ready": F.lit(release.release_ready), "verified": F.lit(False), "affordable": F.lit(False),
            "product_eligible": F.col("reason").isNull(), "calibrated_pd": F.col("p"),
        }
    )
    decided = apply_policy(context, release.policy)
    codes = F.concat(F.array(*[F.lit(c) for c in STANDING_REASONS]), F.array_compact(F.array("reason")), "data_quality_flags")
    return decided.withColumn("reason_codes", codes).select(ID, *RESULT)

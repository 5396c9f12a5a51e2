"""Evidence gates: a build may only start from sources that are declared and proven."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from loanloom.errors import ContractError
from loanloom.operators.history.names import GROUPS

# Names of the boolean gates and the admissible source states.
APPLICATION_GATES = ("annuity_monthly_verified", "category_mapping_verified", "cash_product_verified")
HISTORY_GATES = ("schedule_complete", "schedule_versions_resolved", "payment_identity_verified", "availability_verified")
SOURCE_STATES = ("COMPLETE", "CONFIRMED_EMPTY")


def manifest_blockers(manifest: Mapping, variant: str) -> list[str]:
    """Blockers of the application gates; a research override is only valid for the short contract."""
    if variant not in ("lite", "full"):
        raise ContractError("variant must be lite or full")
    blockers = []
    research = manifest.get("mode") == "RESEARCH"
    if research:
        stated = manifest.get("research_assumptions", {})
        agreed = (
            variant == "lite"
            and manifest.get("release_ready") is False
            and stated.get("income_period") == "annual"
            and stated.get("annuity_period") == "monthly"
            and stated.get("currency") == "unspecified_research_currency"
            and stated.get("dataset_source")
            and stated.get("authorized_by")
        )
        if not agreed:
            blockers.append("Research override requires explicit assumptions and release_ready=false")
    for gate in APPLICATION_GATES:
        if manifest.get(gate) is not True and not (research and gate == "annuity_monthly_verified"):
            blockers.append(f"Unresolved dataset gate: {gate}")
    currency = manifest.get("currency", "")
    if len(currency) != 3 or not (currency.isalpha() and currency.isupper()) or not manifest.get("evidence"):
        blockers.append("Manifest needs currency/domain and evidence references")
    if variant == "full":
        blockers += [f"Full unavailable: {g}" for g in HISTORY_GATES if manifest.get(g) is not True]
    return blockers


def source_blockers(context: Mapping, tables: Mapping[str, DataFrame]) -> list[str]:
    """Per-source state and evidence; an empty declaration is checked by reading one row."""
    blockers = []
    for key in GROUPS:
        entry = context.get("sources", {}).get(key, {})
        if key not in tables or entry.get("state") not in SOURCE_STATES or not entry.get("evidence"):
            blockers.append(f"Full source incomplete: {key}")
        elif entry["state"] == "CONFIRMED_EMPTY" and not tables[key].isEmpty():
            blockers.append(f"Nonempty source declared empty: {key}")
    return blockers


def column_blockers(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]]) -> list[str]:
    """Header-only schema check of all sources; no job is started."""
    blockers = []
    for key, columns in required.items():
        if key not in tables:
            blockers.append(f"Missing source: {key}")
            continue
        missing = sorted(set(columns) - set(tables[key].columns))
        if missing:
            blockers.append(f"{key}: missing columns {', '.join(missing)}")
    return blockers


def enforce_gates(blockers: Sequence[str]) -> None:
    if blockers:
        raise ContractError("; ".join(blockers))


def blockers_frame(spark: SparkSession, blockers: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(b,) for b in blockers], "blocker string")

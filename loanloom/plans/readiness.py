"""Dataset readiness build: gates, application adapter, source profiles, long features, quality reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.errors import ContractError
from loanloom.operators import application as A
from loanloom.operators import profiling as P
from loanloom.operators.contracts import Rule, count_as, duplicate_keys, enforce, union_reports, violation_counts
from loanloom.operators.gates import APPLICATION_GATES, HISTORY_GATES, column_blockers, manifest_blockers, source_blockers
from loanloom.operators.history.assemble import history_features
from loanloom.operators.history.names import GROUPS, HISTORY
from loanloom.operators.ledger import changed_tables
from loanloom.sources import files, sinks
from loanloom.sources.catalog import Catalog
from loanloom.sources.schemas import EVENT_DAY, REQUIRED

FULL = [*A.LITE, *HISTORY]
CODES = {"bureau": ["CREDIT_ACTIVE"], "bureau_balance": ["STATUS"], "previous_application": ["NAME_CONTRACT_STATUS"],
         "pos_cash_balance": ["NAME_CONTRACT_STATUS"], "credit_card_balance": ["NAME_CONTRACT_STATUS"]}


def preflight(manifest: Mapping, tables: Mapping[str, DataFrame]) -> list[str]:
    """Every reason why the long contract may not be built."""
    blockers = manifest_blockers(manifest, "full")
    blockers += [f"Unverified gate: {g}" for g in (*APPLICATION_GATES, *HISTORY_GATES) if manifest.get(g) is not True]
    blockers += source_blockers(manifest, tables)
    return blockers + column_blockers(tables, REQUIRED)


def profile_sources(tables: Mapping[str, DataFrame], eligible: DataFrame) -> dict[str, DataFrame]:
    """Coverage per source, column quality per source and code counters, each as one report."""
    owners = None
    if "bureau" in tables:
        owners = tables["bureau"].select("SK_ID_BUREAU", A.ID)
        enforce(count_as(duplicate_keys(owners, ["SK_ID_BUREAU"]), "Bureau ownership mapping has missing/duplicate account keys"))
    coverage, quality, codes = [], [], []
    for key in GROUPS:
        if key not in tables:
            continue
        df = tables[key]
        via = "SK_ID_BUREAU" if A.ID not in df.columns else None
        if via is None or owners is not None:
            profile = P.source_profile(df, eligible, A.ID, EVENT_DAY[key], owners if via else None, via)
            coverage.append(profile.withColumn("source", F.lit(key)))
        numeric = [c for c in REQUIRED[key] if c in df.columns and c not in (*CODES.get(key, []), "PAYMENT_ID")]
        quality.append(P.column_quality(df, numeric).withColumn("source", F.lit(key)))
        if key in CODES:
            codes.append(P.category_counts(df, CODES[key]).withColumn("source", F.lit(key)))
    return {name: union_reports(parts) for name, parts in
            (("source_coverage", coverage), ("source_column_quality", quality), ("source_categories", codes)) if parts}


def validate_full(df: DataFrame) -> None:
    """Row contract, derived consistency and value rules of the long vector."""
    mismatch = A.derived_mismatch(df)
    rules = [*A.lite_rules(), *A.history_rules([h for h in HISTORY if h in df.columns])]
    checked = df.withColumn("_mismatch", mismatch)
    enforce(violation_counts(checked, [*rules, Rule("Derived feature mismatch", F.col("_mismatch").isNotNull())]))


def build(spark: SparkSession, raw: str, output: str) -> dict:
    """Publish the full dataset, or the application-only dataset together with the blockers."""
    sinks.guard_output(spark, output, raw)
    catalog = Catalog(spark, raw)
    manifest_path = f"{raw}/adapter_manifest.json"
    manifest = files.read_json(spark, manifest_path) if files.exists(spark, manifest_path) else {}
    sources = [k for k in ("application_train", *GROUPS, "installment_schedule") if catalog.exists(k)]
    if "application_train" not in sources:
        raise ContractError("Missing application_train")
    before = catalog.fingerprints(sources).persist()
    tables = catalog.tables(sources)
    blockers = preflight(manifest, tables)
    gate = manifest_blockers(manifest, "lite")
    if gate:
        raise ContractError("; ".join(gate))

    applications = tables["application_train"]
    enforce(count_as(duplicate_keys(applications, [A.ID]), "Missing or duplicate applicant"))
    enforce(violation_counts(applications, A.label_rules()))
    adapted = A.adapt_applications(applications).persist()
    excluded = adapted.where(F.col("reason").isNotNull())
    frame = adapted.where(F.col("reason").isNull()).select(A.ID, A.LABEL, *A.LITE)
    if frame.isEmpty():
        raise ContractError("No eligible training applications")
    sinks.write_report(excluded.select(F.col(A.ID).alias("id"), "reason"), f"{output}/excluded_applications")
    for name, report in profile_sources(tables, frame.select(A.ID)).items():
        sinks.write_report(report, f"{output}/{name}")

    if not blockers:
        try:
            history = history_features(frame.select(A.ID), tables, tables["installment_schedule"], manifest)
            full = frame.join(history, A.ID, "left")
            validate_full(full)
            frame = full
        except ContractError as exc:
            blockers.append(f"Canonical full aggregation/validation failed: {exc}")
    ready = not blockers
    name = "full_features" if ready else "application_features_only"
    sinks.write_features(frame, f"{output}/{name}.parquet")
    written = spark.read.parquet(f"{output}/{name}.parquet")
    owners = {f: g for g, names in GROUPS.items() for f in names}
    sinks.write_report(P.feature_quality(written, FULL, owners, A.CATEGORICAL), f"{output}/feature_quality")
    numeric = [c for c in FULL if c in written.columns and c not in A.CATEGORICAL]
    sinks.write_report(P.feature_histograms(written, numeric), f"{output}/feature_histograms")
    if not changed_tables(before, catalog.fingerprints(sources)).isEmpty():
        raise ContractError("Input changed during build; discard output and rerun")
    counts = adapted.agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("x")).first()
    result = {
        "status": "FULL_CONTRACT_VALIDATED" if ready else "BLOCKED", "training_ready": ready, "release_ready": False,
        "source_application_rows": counts["n"], "eligible_rows": counts["n"] - counts["x"], "excluded_rows": counts["x"],
        "required_features": len(FULL), "generated_features": len(set(FULL) & set(written.columns)),
        "unavailable_features": [c for c in FULL if c not in written.columns], "dataset": f"{name}.parquet",
        "dataset_digest": sinks.digest_values(written), "blockers": blockers,
        "inputs": {r["table_name"]: [r["row_count"], r["digest_sum"], r["digest_xor"]] for r in before.collect()},
    }
    files.write_json(spark, f"{output}/build_manifest.json", result)
    before.unpersist()
    adapted.unpersist()
    return result


def feature_table(spark: SparkSession, raw: str, cache: str, variant: str = "lite") -> DataFrame:
    """Validated feature table of labeled and unlabeled applications, cached under its input digests."""
    catalog = Catalog(spark, raw)
    manifest_path = f"{raw}/adapter_manifest.json"
    if not files.exists(spark, manifest_path):
        raise ContractError("Missing adapter_manifest.json: verify source semantics before training")
    manifest = files.read_json(spark, manifest_path)
    gate = manifest_blockers(manifest, variant)
    if gate:
        raise ContractError("; ".join(gate))
    keys = ["application_train", "application_test"]
    if variant == "full":
        keys += [*GROUPS, "installment_schedule"]
    keys = [k for k in keys if catalog.exists(k)]
    digests = {r["table_name"]: [r["row_count"], r["digest_sum"], r["digest_xor"]] for r in catalog.fingerprints(keys).collect()}

    def make() -> DataFrame:
        train = catalog.load("application_train")
        enforce(count_as(duplicate_keys(train, [A.ID]), "Missing or duplicate applicant"))
        enforce(violation_counts(train, A.label_rules()))
        rows = train.withColumn("IS_TRAIN", F.lit(1))
        if catalog.exists("application_test"):
            test = catalog.load("application_test")
            enforce(count_as(A.overlap(train, test), "Train/test customer overlap"))
            rows = A.union_snapshots(train, test)
        frame = A.eligible_features(rows)
        if frame.isEmpty():
            raise ContractError("No valid application rows")
        if variant == "full":
            tables = catalog.tables(list(GROUPS))
            history = history_features(frame.select(A.ID), tables, catalog.load("installment_schedule"), manifest)
            frame = frame.join(history, A.ID, "left")
        return frame

    inputs = {"variant": variant, "rules": "1", "sources": digests}
    return sinks.FeatureCache(spark, cache).get_or_build(inputs, make, validate_full)

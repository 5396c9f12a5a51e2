"""Feature, report and run outputs."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from loanloom.errors import ContractError
from loanloom.functions.digest import table_digest
from loanloom.functions.nullsafe import clean_floats
from loanloom.sources import files


def guard_output(spark: SparkSession, output: str, raw: str) -> None:
    """Refuse an output that is not empty, or that lies in, or around, the raw directory."""
    out, src = files.qualified(spark, output), files.qualified(spark, raw)
    if out == src or out.startswith(src + "/") or src.startswith(out + "/"):
        raise ContractError("Output must be a separate directory, outside raw sources")
    if files.listing(spark, output):
        raise ContractError("Output directory must be empty; choose a new build directory")


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """Report rows as CSV or JSON with NaN written as null."""
    clean = clean_floats(df)
    if form == "csv":
        clean.write.mode("errorifexists").csv(path, header=True)
    elif form == "json":
        clean.write.mode("errorifexists").json(path, ignoreNullFields=False)
    else:
        raise ContractError(f"Unknown report format: {form}")


def digest_values(df: DataFrame) -> dict:
    row = table_digest(df).first()
    return {"row_count": row["row_count"], "digest_sum": row["digest_sum"], "digest_xor": row["digest_xor"]}


def address(inputs: Mapping) -> str:
    """Content address of a build: hash of the input fingerprints and the rule version."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True).encode()).hexdigest()


class FeatureCache:
    """Parquet results under the address of their inputs; the stored digest is verified on every hit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def get_or_build(self, inputs: Mapping, build, check=None) -> DataFrame:
        base = f"{self.root}/features_{address(inputs)[:16]}"
        data, report = f"{base}.parquet", f"{base}.json"
        if files.exists(self.spark, data) and files.exists(self.spark, report):
            stored = self.spark.read.parquet(data)
            if digest_values(stored) == files.read_json(self.spark, report)["digest"]:
                if check is not None:
                    check(stored)
                return stored
        build().write.mode("overwrite").parquet(data)
        written = self.spark.read.parquet(data)
        if check is not None:
            check(written)
        files.write_json(self.spark, report, {"inputs": dict(inputs), "digest": digest_values(written)}, overwrite=True)
        return written


class RunDirectory:
    """Immutable ``runs/<id>`` with a ``latest`` pointer that is written last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def start(self) -> str:
        stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
        return f"{stamp}-{uuid.uuid4().hex[:8]}"

    def path(self, run_id: str) -> str:
        if "/" in run_id or run_id in ("", ".", ".."):
            raise ContractError("Invalid run id")
        return f"{self.root}/runs/{run_id}"

    def publish(self, run_id: str, metadata: Mapping, tables: Mapping[str, DataFrame]) -> None:
        base = self.path(run_id)
        digests = {}
        for name, df in tables.items():
            write_features(df, f"{base}/{name}.parquet")
            digests[name] = digest_values(self.spark.read.parquet(f"{base}/{name}.parquet"))
        files.write_json(self.spark, f"{base}/metadata.json", {**metadata, "run_id": run_id, "artifacts": digests})
        files.write_json(self.spark, f"{self.root}/latest.json", {"run_id": run_id}, overwrite=True)

    def latest(self) -> str:
        pointer = f"{self.root}/latest.json"
        if not files.exists(self.spark, pointer):
            raise ContractError("No release has been published")
        return files.read_json(self.spark, pointer)["run_id"]

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        """A table of a run, verified against the digest in its metadata."""
        base = self.path(run_id or self.latest())
        if not files.exists(self.spark, f"{base}/metadata.json"):
            raise ContractError("Incomplete release")
        expected = files.read_json(self.spark, f"{base}/metadata.json")["artifacts"][table]
        df = self.spark.read.parquet(f"{base}/{table}.parquet")
        if digest_values(df) != expected:
            raise ContractError(f"Release checksum mismatch: {table}")
        return df

"""Named source tables in one directory, as CSV or Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, StringType, StructField

from loanloom.errors import ContractError
from loanloom.functions.nullsafe import clean_floats
from loanloom.operators.ledger import fingerprints
from loanloom.sources import files
from loanloom.sources.schemas import ALIASES, REQUIRED, SCHEMAS


#: Sources whose adapter casts numbers itself.
TEXT_NUMBERS = ("application_train", "application_test")


class Catalog:
    """Finds a source by key under its known names, whatever the case of the file."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def locate(self, key: str) -> str | None:
        if key not in ALIASES:
            raise ContractError(f"Unknown source: {key}")
        present = {name.lower(): name for name in files.listing(self.spark, self.root)}
        for alias in ALIASES[key]:
            for suffix in (".parquet", ".csv"):
                if alias.lower() + suffix in present:
                    return f"{self.root}/{present[alias.lower() + suffix]}"
        return None

    def exists(self, key: str) -> bool:
        return self.locate(key) is not None

    def header(self, key: str) -> list[str]:
        """Column names only: the CSV header line, or the Parquet footer."""
        path = self._required(key)
        if path.endswith(".parquet"):
            return self.spark.read.parquet(path).columns
        return self.spark.read.csv(path, header=True).columns

    def load(self, key: str, columns: Sequence[str] | None = None) -> DataFrame:
        """Declared types, malformed lines fail, NaN becomes null, optional columns may be absent.

        Amounts and days of applications stay text: the adapter casts each row and gives a malformed number as that
        row's reason, so that one bad number excludes one row instead of stopping the job.
        """
        path = self._required(key)
        declared = {f.name: f for f in SCHEMAS[key].fields}
        if key in TEXT_NUMBERS:
            declared = {n: StructField(n, StringType()) if f.dataType == DoubleType() else f for n, f in declared.items()}
        if path.endswith(".parquet"):
            df = self.spark.read.parquet(path)
            df = df.select(*[df[c].cast(declared[c].dataType).alias(c) if c in declared else df[c] for c in df.columns])
        else:
            names = self.header(key)
            # columns outside the contract are read as text and can be pruned
            ddl = ", ".join(f"`{n}` {declared[n].dataType.simpleString() if n in declared else 'string'}" for n in names)
            df = self.spark.read.schema(ddl).csv(path, header=True, mode="FAILFAST", nullValue="", nanValue="NaN")
        df = clean_floats(df)
        return df.select(*columns) if columns else df

    def missing_columns(self) -> dict[str, list[str]]:
        """Required columns that a present source lacks; no job runs."""
        out = {}
        for key, needed in REQUIRED.items():
            if self.exists(key):
                lacking = sorted(set(needed) - set(self.header(key)))
                if lacking:
                    out[key] = lacking
        return out

    def tables(self, keys: Sequence[str]) -> dict[str, DataFrame]:
        return {k: self.load(k) for k in keys if self.exists(k)}

    def fingerprints(self, keys: Sequence[str]) -> DataFrame:
        """Content digests of the present sources."""
        return fingerprints(self.tables(keys))

    def _required(self, key: str) -> str:
        path = self.locate(key)
        if path is None:
            raise FileNotFoundError(f"'{key}' not found in {self.root}. Expected one of: {ALIASES[key]}")
        return path


def ledger_table(spark: SparkSession, path: str | None = None, **jdbc: str) -> DataFrame:
    """Ledger extract from Parquet, or a partitioned JDBC read when connection options are given."""
    if path is not None:
        return spark.read.parquet(path)
    return spark.read.format("jdbc").options(**jdbc).load()

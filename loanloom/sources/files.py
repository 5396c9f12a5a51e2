"""Small file-system helpers that work on any Hadoop path."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a directory."""
    if not exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path)))


def qualified(spark: SparkSession, path: str) -> str:
    return _fs(spark, path).makeQualified(_path(spark, path)).toString().rstrip("/")


def write_text(spark: SparkSession, path: str, text: str, *, overwrite: bool = False) -> None:
    """Write a small report: to a temporary name first, then renamed into place."""
    fs, target, part = _fs(spark, path), _path(spark, path), _path(spark, path + ".tmp")
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"Could not publish {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def write_json(spark: SparkSession, path: str, value: object, *, overwrite: bool = False) -> None:
    """Report values only; NaN is refused."""
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, allow_nan=False), overwrite=overwrite)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))

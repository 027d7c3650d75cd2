"""A report's sections as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_report(report: dict[str, DataFrame], path: str, fmt: str = "parquet") -> list[str]:
    """Write each section to a folder of its own under ``path``; the folders."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unknown format: {fmt}")
    folders = []
    for name, section in report.items():
        folders.append(f"{path.rstrip('/')}/{name}")
        section.write.mode("overwrite").format(fmt).save(folders[-1])
    return folders


def read_report(spark: SparkSession, path: str, names: list[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    return {n: spark.read.format(fmt).load(f"{path.rstrip('/')}/{n}") for n in names}

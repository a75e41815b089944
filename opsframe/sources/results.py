"""Results: facts and a one-row coverage table that says what was cut or missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(facts: DataFrame, truncated: bool = False, warnings: tuple[str, ...] = ()) -> DataFrame:
    """One row: status (ok, partial, empty), rows, warnings.  Empty is a valid result and never means healthy."""
    status = F.when(F.col("rows") == 0, "empty").otherwise("partial" if truncated or warnings else "ok")
    told = F.array(*map(F.lit, dict.fromkeys(warnings))).cast("array<string>")
    return facts.agg(F.count(F.lit(1)).alias("rows")).select(status.alias("status"), "rows", told.alias("warnings"))


def write_result(facts: DataFrame, cover: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    facts.write.mode(mode).format(fmt).save(f"{path}/facts")
    cover.write.mode(mode).format(fmt).save(f"{path}/coverage")

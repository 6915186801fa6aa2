"""Column expressions on streams: they are stateless, so a stream takes them as a table does."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame


def project(frame: DataFrame, columns: Mapping[str, Column], keep: Column | None = None) -> DataFrame:
    """``frame`` (streaming or not) with ``columns`` added, and only the rows where ``keep`` holds."""
    rows = frame if keep is None else frame.where(keep)
    return rows.withColumns(dict(columns))

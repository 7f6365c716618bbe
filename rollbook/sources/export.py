"""Fixed-layout text export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"


@dataclass(frozen=True)
class ExportColumn:
    """One output column: a source column, a constant, or (neither given) an empty placeholder."""

    header: str
    source: str | None = None
    constant: object = None
    as_timestamp: bool = False


def export_layout(df: DataFrame, layout: list[ExportColumn]) -> DataFrame:
    """Project to the headers of ``layout``; a header is emitted once even if it is listed twice."""
    out, seen = [], set()
    for item in layout:
        if item.header in seen:
            continue
        seen.add(item.header)
        if item.source is not None:
            value = F.col(f"`{item.source}`")
            if item.as_timestamp:
                value = F.date_format(value.cast("timestamp_ntz"), TIMESTAMP_TEXT)
        elif item.constant is not None:
            value = F.lit(item.constant)
        else:
            value = F.lit(None).cast("string")
        out.append(value.alias(item.header))
    return df.select(*out)

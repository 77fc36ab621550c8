"""Result schemas that carry columns of a caller's type."""

from __future__ import annotations

from pyspark.sql.types import DataType, StructField, StructType


def schema(*parts: str | tuple[str, DataType]) -> StructType:
    """Columns in order: DDL text, or a name with the type it has in the input."""
    fields: list[StructField] = []
    for part in parts:
        fields += StructType.fromDDL(part).fields if isinstance(part, str) else [StructField(*part)]
    return StructType(fields)

"""The package's functions for use in SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from leadloom.functions import size, text

#: Arrow functions by their SQL names; everything else is a Column expression.
ARROW = {"fold_exact": text.fold_exact, "extract_employee_size": size.extract_employee_size, "size_evidence": size.size_evidence}


def register_all(spark: SparkSession) -> list[str]:
    """Register the Arrow functions in a session; their names."""
    for name, function in ARROW.items():
        spark.udf.register(name, function)
    return sorted(ARROW)

"""Resuming runs and recovering damaged documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType


def pending(wanted: DataFrame, done: DataFrame, on: list[str], config: str, overwrite: bool = False) -> DataFrame:
    """Rows that are still to do. Output made under another configuration is an error unless it is overwritten."""
    if overwrite:
        return wanted
    other = done.filter(~F.col("config").eqNullSafe(F.lit(config))).limit(1).collect()
    if other:
        raise ValueError(f"output exists with another configuration: {other[0]['config']!r}; overwrite it or choose another place")
    return wanted.join(done.select(*on).distinct(), on, "left_anti")


@F.pandas_udf(StructType([StructField("document", StringType()), StructField("recovered", BooleanType())]))
def first_document(text: pd.Series) -> pd.DataFrame:
    """The first JSON document of a text, and whether something followed it; null if there is none."""
    rows = []
    for value in text:
        try:
            document, end = json.JSONDecoder().raw_decode((value or "").lstrip())
            rows.append((json.dumps(document, ensure_ascii=False), bool((value or "").lstrip()[end:].strip())))
        except ValueError:
            rows.append((None, False))
    return pd.DataFrame(rows, columns=["document", "recovered"])

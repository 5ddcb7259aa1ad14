"""Feature matrices as CSV whose header names the role of each column.

``id#k`` is an identifier, ``<split>#k`` a category of a split, a bare name a
continuous feature.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLE = re.compile(r"^(id|\d+)#(.+)$")


def write_features(df: DataFrame, path: str, ids: list[str], categories: dict[int, list[str]], continuous: list[str]) -> None:
    columns = [F.col(c).alias(f"id#{c}") for c in ids] + [F.col(c) for c in continuous]
    columns += [F.col(c).alias(f"{k}#{c}") for k in sorted(categories) for c in categories[k]]
    df.select(*columns).write.csv(path, header=True, mode="overwrite")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """(rows, roles): ids as text, features as doubles, null where they cannot be read; rows of another length are left out."""
    raw = spark.read.csv(path, header=True, mode="DROPMALFORMED")
    roles: dict[str, list[str]] = {}
    columns = []
    for name in raw.columns:
        found = ROLE.match(name)
        role, plain = found.groups() if found else ("continuous", name)
        roles.setdefault(role, []).append(plain)
        value = F.col(f"`{name}`")
        columns.append((value if role == "id" else F.when(~F.isnan(value.try_cast("double")), value.try_cast("double"))).alias(plain))
    return raw.select(*columns), roles

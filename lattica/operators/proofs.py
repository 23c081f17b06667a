"""Commitments of attestations: SHA-256 over scope, claim, number of perspectives and mean weight."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType


@pandas_udf(BinaryType())
def _double_bytes(values: pd.Series) -> pd.Series:
    """The eight bytes of a double, lowest first; Spark has no function for them."""
    rows = values.to_numpy(dtype="<f8").tobytes()
    return pd.Series([rows[k : k + 8] for k in range(0, len(rows), 8)])


def long_bytes(value: Column) -> Column:
    """The eight bytes of a long, lowest first."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in range(15, 0, -2)]))


def commitment(scope: Column, claim: Column, count: Column, weight: Column) -> Column:
    """Hex digits of the commitment; null scope and claim are empty, null numbers zero."""
    text = F.concat(F.coalesce(scope, F.lit("")), F.coalesce(claim, F.lit("")))
    number = long_bytes(F.coalesce(count.cast("long"), F.lit(0).cast("long")))
    return F.sha2(F.concat(F.encode(text, "UTF-8"), number, _double_bytes(F.coalesce(weight.cast("double"), F.lit(0.0)))), 256)


def proven(attestations: DataFrame) -> DataFrame:
    """``attestations`` (scope, claim_type, perspective_count, avg_weight) with proof_type and proof_hex."""
    made = commitment(*[F.col(c) for c in ("scope", "claim_type", "perspective_count", "avg_weight")])
    return attestations.withColumns({"proof_type": F.lit("sha256_commitment"), "proof_hex": made})


def verified(attestations: DataFrame) -> DataFrame:
    """``attestations`` with ``valid``: whether proof_hex is what its row commits to; without a proof it is not."""
    made = commitment(*[F.col(c) for c in ("scope", "claim_type", "perspective_count", "avg_weight")])
    return attestations.withColumn("valid", F.coalesce(made == F.lower("proof_hex"), F.lit(False)))

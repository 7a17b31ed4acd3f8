"""Joins and lookups that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than this share of the rows, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.002
SALTS = 64


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = 10_000) -> list:
    """Keys with more than `share` of all rows and at least `least` of them.

    At most 1/share values reach the driver, whatever the size of df. df should be cheap to
    read (a raw column, a staged table): it is counted first, which Parquet answers from its footers,
    and small inputs end there.
    """
    total = df.count()
    if total < least:
        return []
    counts = df.groupBy(key).count()
    return [r[0] for r in counts.filter((F.col("count") >= least) & (F.col("count") > share * total) & F.col(key).isNotNull()).select(key).collect()]


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = SALTS, counted: DataFrame | None = None) -> DataFrame:
    """Equi-join big with small, which is unique on `key`, splitting the hot keys of big.

    Rows of big with a hot key get one of `salts` salts; the few matching rows of small
    (at most 1/HOT_SHARE) are repeated once per salt. All other keys have salt 0.
    NULL keys match nothing, as in any equi-join. Extra columns of both sides are kept.
    `counted` names a cheaper frame with the same keys (a raw column, a staged table) to find
    the hot ones in, so that what big computes is not computed for it.
    """
    hot = hot_keys(big.select(key) if counted is None else counted.select(key), key)
    if not hot:
        return big.join(small, key, how)
    # The salt is a hash of the row, so a task that is run again after a loss gives the same rows.
    hashed = [c for c, kind in big.dtypes if not kind.startswith("map<")]
    salt = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*hashed), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(copies))
    return left.join(right, [key, "_salt"], how).drop("_salt")

"""Stratified train/test split, exact per-stratum share, reproducible.

Each row's place in its stratum is fixed by ``md5(seed|id)``, so the split
does not depend on partitioning or on re-execution after a lost executor
(unlike ``rand()``-based sampling), and every stratum gets exactly
``ceil(test_size * n_stratum)`` test rows (unlike Bernoulli ``sampleBy``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.ranking import md5_key, rank_by_hash


def stratified_split(df: DataFrame, id_col: str, stratum_col: str, test_size: float = 0.3,
                     seed: int = 42, out: str = "is_test") -> DataFrame:
    """Adds boolean ``out``: True for the test part."""
    h = df.withColumn("_h", md5_key(seed, id_col))
    r = rank_by_hash(h, [stratum_col], "_h", out="_rank")
    k = F.ceil(F.lit(test_size) * F.col("_stratum_n"))
    return r.withColumn(out, F.col("_rank") <= k).drop("_h", "_rank", "_stratum_n")

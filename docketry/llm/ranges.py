"""Range buckets of an integer key, without a shuffle of the rows they are computed for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import estimated_bytes, shuffle_partitions

#: Buckets for each shuffle partition at least, and one for each BUCKET_BYTES of input.
BUCKETS_PER_PARTITION, BUCKET_BYTES, MOST_BUCKETS = 4, 128 << 20, 200_000


def bounds(df: DataFrame, key: str, buckets: int | None = None) -> list[int]:
    """Ascending lower bounds of all buckets but the first, from approximate quantiles of the key alone."""
    n = buckets or min(MOST_BUCKETS, max(BUCKETS_PER_PARTITION * shuffle_partitions(df.sparkSession), estimated_bytes(df) // BUCKET_BYTES))
    keys = df.select(F.col(key).cast("double").alias("k")).where("k is not null")
    found = keys.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    return sorted({int(np.ceil(x)) for x in found})


def bucket_of(key: Column, lows: list[int]) -> Column:
    """The bucket from 0 up; null keys are in bucket 0."""
    at = np.array(lows, dtype=np.int64)

    @F.arrow_udf("int")
    def find(k: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(at, k.fill_null(-(2**62)).to_numpy(zero_copy_only=False), side="right").astype("int32"))

    return find(key.cast("long")) if lows else F.lit(0)

"""Joins with a side that is small as a rule but not by definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkline.session import checkpoint_dir

BROADCAST_ROWS = 50_000     # narrow rows: a few MB
SALTS = 32


def lookup(big: DataFrame, small: DataFrame, keys: str | list[str], broadcast_rows: int = BROADCAST_ROWS,
           null_safe: bool = False, salts: int = SALTS) -> DataFrame:
    """Left join of ``big`` with ``small`` (one narrow row per key).

    The small side is computed once, into the shared checkpoint folder, and
    counted there (a job while the query is built). Within the bound it is
    broadcast, and ``big`` is not shuffled. Beyond it ``big`` is shuffled by the
    keys and a salt, so a frequent key is spread over ``salts`` tasks. The rows are
    the same either way. ``null_safe`` lets a NULL key meet a NULL key (otherwise
    it meets nothing); ``big``'s columns come first, then ``small``'s others.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    checkpoint_dir(small.sparkSession)
    small = small.checkpoint(eager=True)
    extra = [c for c in small.columns if c not in keys]
    own = {k: f"_lookup_{i}" for i, k in enumerate(keys)}
    side = small.select(*[F.col(k).alias(own[k]) for k in keys], *extra)

    def equal(k: str) -> Column:
        return big[k].eqNullSafe(F.col(own[k])) if null_safe else big[k] == F.col(own[k])

    if small.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return big.join(F.broadcast(side), [equal(k) for k in keys], "left").select(*[big[c] for c in big.columns], *extra)
    salt = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
    salted = big.withColumn("_salt", salt)
    spread = side.withColumn("_side_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [salted[k].eqNullSafe(F.col(own[k])) if null_safe else salted[k] == F.col(own[k]) for k in keys]
    return (salted.join(spread, [*on, F.col("_salt") == F.col("_side_salt")], "left")
            .select(*[salted[c] for c in big.columns], *extra))

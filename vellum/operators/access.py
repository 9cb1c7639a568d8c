"""Access as tables: new ids for inserted rows, and grants of users on stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.model import Identity


def with_new_ids(rows: DataFrame, identity: Identity, live: DataFrame, seed: int) -> DataFrame:
    """``rows`` with a random ``_id`` each that no row of ``live`` has; ``None`` where it would collide, to be drawn again.

    The draw is seeded by partition, so write the result before it is used twice.
    """
    drawn = rows.withColumn("_id", F.randstr(F.lit(identity.length), F.lit(seed)))
    taken = live.select(F.col("_id").alias("__taken")).distinct()
    return drawn.join(taken, F.col("_id") == F.col("__taken"), "left").withColumn("_id", F.when(F.col("__taken").isNull(), F.col("_id"))).drop("__taken")


def permitted(requests: DataFrame, grants: DataFrame, right: str, user: str = "user", store: str = "store") -> DataFrame:
    """The requests whose user holds ``right`` (a boolean column of ``grants``) on their store."""
    held = grants.where(F.col(right)).select(user, store)
    return requests.join(held, [user, store], "left_semi")

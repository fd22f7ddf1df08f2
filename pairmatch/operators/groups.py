"""User functions on the groups or parts of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairmatch.operators.joins import hot_keys, shuffle_partitions
from pairmatch.operators.sampling import SEED
from pairmatch.session import written


def apply_groups(
    df: DataFrame, fn: Callable[..., pd.DataFrame], schema: str, **kwargs
) -> DataFrame:
    """Run ``fn(frame, **kwargs)`` on parts of the table and stack the results.

    The parts exist for parallelism only: ``fn`` must give each row the same result in any
    part. Spark hands it one Arrow batch after the other, so memory stays bounded however the
    rows are distributed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch, **kwargs)

    return df.mapInPandas(run, schema)


def apply_by_key(
    df: DataFrame,
    key: str | list[str],
    fn: Callable[..., Iterator[pd.DataFrame]],
    schema: str,
    **kwargs,
) -> DataFrame:
    """Run ``fn(frames, **kwargs)`` on every group of ``key`` and stack what it yields.

    ``frames`` iterates over the rows of one group, an Arrow batch at a time, so a large group
    is never held at once; ``fn`` sees each row once, in any order, and may yield as many frames
    as it likes. Each group is one pass of one task: where groups may be very large, use
    ``combine_by_key``. A null key is a group of its own. No rows, no groups.
    """
    result = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in fn((batch.to_pandas() for batch in batches), **kwargs):
            yield from pa.Table.from_pandas(frame, result, preserve_index=False).to_batches()

    return df.groupBy(key).applyInArrow(run, schema)


def combine_by_key(
    df: DataFrame,
    key: str | list[str],
    part: Callable[..., pd.DataFrame],
    combine: Callable[..., Iterator[pd.DataFrame]],
    part_schema: str,
    schema: str,
    **kwargs,
) -> DataFrame:
    """A function of whole groups from parts of them, for keys that hold many rows.

    ``part(frame, **kwargs)`` gets rows of one key in one batch and returns a few rows with the
    key; ``combine`` works on these as in ``apply_by_key``. Rows are brought together by key
    first, so ``part`` runs about once for a key with few rows, however many keys there are; keys
    with many rows are dealt over partitions by their share, and send a row or two for each batch.
    """
    keys = [key] if isinstance(key, str) else list(key)
    result = arrow_schema(df, part_schema)
    hot = hot_keys(written(df.groupBy(*keys).agg(F.count("*").alias("n")), "key-counts"), keys)
    hot = hot.select(*[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)], "_salts")
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{i}")) for i, k in enumerate(keys)]
    salt = F.floor(F.rand(SEED) * F.coalesce("_salts", F.lit(1))).cast("int").alias("_salt")
    dealt = (
        df.join(F.broadcast(hot), reduce(and_, same), "left")
        .select(*df.columns, salt)
        .repartition(shuffle_partitions(df), *keys, "_salt")
        .sortWithinPartitions(*keys)
        .drop("_salt")
    )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.to_pandas().groupby(keys, dropna=False, sort=False)
            frames = [part(group, **kwargs) for _, group in groups]
            tables = [pa.Table.from_pandas(x, result, preserve_index=False) for x in frames]
            yield from pa.concat_tables(tables).combine_chunks().to_batches() if tables else ()

    summed = written(dealt.mapInArrow(parts, part_schema), "parts")
    return apply_by_key(summed, keys, combine, schema, **kwargs)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    """The Arrow types of a schema text."""
    empty = df.sparkSession.createDataFrame([], StructType.fromDDL(schema))
    return empty.toArrow().schema

"""Simulated panels against data: rank matching, truncated draws, replicated moments and comparisons."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions.quantiles import ranked
from cohortlake.plans import panel_moments, simulation


def ordinal_transform(model: DataFrame, data: DataFrame, keys: Sequence[str], value: str, data_value: str, id_: str = "id", threshold: float = 0.0) -> DataFrame:
    """Each model value takes the data value of its own share of ranks: model rank k of n maps to data rank ceil(k m / n) of m. Data
    at or below the threshold are left out; data without the keys serve all groups."""
    own = ranked(model, keys, [value, id_])
    shared = [k for k in keys if k in data.columns]
    kept = data.filter(F.col(data_value) > threshold)
    numbered = ranked(kept, shared, [data_value]).select(*shared, F.col("_k").alias("_at"), F.col(data_value).alias("transformed"))
    sizes = kept.groupBy(*shared).agg(F.count(F.lit(1)).alias("_m")) if shared else kept.agg(F.count(F.lit(1)).alias("_m"))
    placed = (own.join(F.broadcast(sizes), shared) if shared else own.crossJoin(F.broadcast(sizes))).withColumn("_at", F.greatest(F.ceil(F.col("_k") * F.col("_m") / F.col("_n")), F.lit(1)).cast("int"))
    return placed.join(numbered, [*shared, "_at"], "left").select(id_, *keys, value, "transformed")


def truncated_draws(data: DataFrame, value: str, threshold: float, k: int, seed: str = "draw") -> DataFrame:
    """k reproducible draws from the values above a threshold, in the order of a digest."""
    from cohortlake.functions.scalar import md5_uniform

    return data.filter(F.col(value) > threshold).withColumn("_u", md5_uniform(seed, F.col(value))).orderBy("_u", value).limit(k).select(value)


def bootstrap_moments(spark: SparkSession, theta: np.ndarray, n: int, replicates: int, steps: int = simulation.STEPS) -> DataFrame:
    """grp, i (flat place), mean and sd of each moment over replicates with their own shocks; one replicate is one task's work."""
    x = [float(v) for v in theta]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep in batch.column("id").to_pylist():
                found = panel_moments.moment_vector(simulation.simulate(np.array(x), simulation.shocks(n, steps, 1000 + rep)))
                for grp, values in found.items():
                    flat = np.ravel(values)
                    yield pa.RecordBatch.from_arrays([pa.array([grp] * len(flat)), pa.array(np.arange(len(flat))), pa.array(flat)], names=["grp", "i", "value"])

    rows = spark.range(0, replicates, 1, min(replicates, 64)).mapInArrow(run, "grp string, i long, value double")
    return rows.groupBy("grp", "i").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def compared(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Largest and mean absolute difference, and correlation, of two tables of cells."""
    joined = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("z")), list(keys))
    return joined.agg(F.max(F.abs(F.col("x") - F.col("z"))).alias("max_diff"), F.avg(F.abs(F.col("x") - F.col("z"))).alias("mean_diff"), F.corr("x", "z").alias("r"))

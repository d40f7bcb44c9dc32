"""Size statistics of a growing text collection: python -m jobs.text_profile SOURCE TARGET CHECKPOINT [--config FILE]

A file stream over SOURCE/documents.parquet takes the files that are new since the last run (availableNow, offsets in CHECKPOINT) and
writes one narrow row for each document to TARGET/measures, partitioned by micro-batch; a batch that is repeated after a failure
replaces its own partition. Then the statistics by source and language (number, words, moments of log words, percentiles, percentile
skewness and the share of words in the largest documents) are made anew for the parts of the sources that batches have reached and the
profile has not, and those partitions of TARGET/profile are replaced. What a part covers is its rows' last batch, so a run that was lost
between the two steps is made good by the next. Without new files a run changes nothing.

Files must not be changed once read. A null text has no words; documents without words count in n and in no statistic of words. Null
sources and languages are groups of their own.
"""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import moments as mo
from cohortlake.functions import quantiles as qu

CONFIG = Path(__file__).with_suffix(".json")
GROUP = ["source", "lang"]
MEASURES = "doc_id bigint, source string, lang string, part int, n_chars bigint, n_words bigint, batch bigint"
log = logging.getLogger("jobs.text_profile")


def settings(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def measured(documents: DataFrame, parts: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    part = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", part.alias("part"), F.length(text).cast("bigint").alias("n_chars"), words.cast("bigint").alias("n_words"))


def take_new(spark: SparkSession, source: str, target: str, checkpoint: str, config: Mapping) -> None:
    """Measure the documents of files that the checkpoint does not know."""
    path = f"{source.rstrip('/')}/documents.parquet"

    def write(batch: DataFrame, number: int) -> None:
        rows = measured(batch, config["parts"]).withColumn("batch", F.lit(number).cast("bigint"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{target}/measures")
        log.info("batch %d: measured %d documents", number, spark.read.schema(MEASURES).parquet(f"{target}/measures").filter(F.col("batch") == number).count())

    # as a pattern, since the table may be one file as well as a folder of files, and a stream's plain path must be a folder
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{path[:-1]}[{path[-1]}]")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def statistics(measures: DataFrame, config: Mapping) -> DataFrame:
    """part, source, lang and their statistics, with the last batch of the part."""
    keys = ["part", *GROUP]
    some = measures.filter("n_words > 0").withColumn("words", F.col("n_words").cast("double"))
    every = measures.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words"), F.sum("n_chars").alias("n_chars"))
    x = F.ln(F.col("words"))
    shape = [c.alias(f"{k}_log") for k, c in mo.raw(x).items() if k != "n"]
    probs = sorted({10, 50, 90, *config["percentiles"]})
    spread = qu.group_percentiles(some, keys, "words", probs, extra=shape).withColumn("kelley", mo.kelley(F.col("p10"), F.col("p50"), F.col("p90")))
    top = qu.top_shares(some, keys, "words", (config["top_percent"],))
    last = measures.groupBy("part").agg(F.max("batch").alias("through"))
    return qu.null_safe(qu.null_safe(every, spread, keys, "left"), top, keys, "left").join(last, "part")


def profile_schema(config: Mapping) -> str:
    points = ", ".join(f"{qu.name_of(p)} double" for p in sorted({10, 50, 90, *config["percentiles"]}))
    return f"source string, lang string, n bigint, n_words bigint, n_chars bigint, mean_log double, sd_log double, skew_log double, kurt_log double, {points}, kelley double, top{qu.name_of(config['top_percent'])[1:]} double, through bigint, part int"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def profile_new(spark: SparkSession, target: str, config: Mapping) -> None:
    """Make the parts anew that have batches the profile does not cover."""
    measures, profile = stored(spark, f"{target}/measures", MEASURES), stored(spark, f"{target}/profile", profile_schema(config))
    reached, covered = measures.groupBy("part").agg(F.max("batch").alias("batch")), profile.groupBy("part").agg(F.max("through").alias("through"))
    due = [r["part"] for r in reached.join(covered, "part", "left").filter("through is null or through < batch").collect()]  # at most `parts` rows
    log.info("%d of at most %d parts have new documents", len(due), config["parts"])
    if due:
        # partitions of a file are read whole before the write that replaces them starts: the rows come from measures alone
        found = statistics(measures.filter(F.col("part").isin(due)), config)
        found.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{target}/profile")


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: Mapping) -> DataFrame:
    """The whole profile as it stands in target after this run."""
    take_new(spark, source, target, checkpoint, config)
    profile_new(spark, target, config)
    profile = stored(spark, f"{target}/profile", profile_schema(config))
    log.info("profile of %s: %d groups", target, profile.count())
    return profile.drop("through", "part")


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("source", "target", "checkpoint"):
        parser.add_argument(name)
    parser.add_argument("--config", default=str(CONFIG))
    a = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("text_profile").getOrCreate()
    try:
        run(spark, a.source, a.target, a.checkpoint, settings(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

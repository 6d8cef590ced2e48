"""The same steps on streams: all work on a read is stateless; statistics are streaming aggregations.

The choice of adapters needs a bounded prefix of the reads, so it is made on a batch before the stream starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.config import Config
from strandflow.operators import filters
from strandflow.plans import pipeline

READS = "read_id long, header string, seq string, qual string"


def read_stream(spark: SparkSession, path: str, schema: str = READS, files_per_trigger: int = 8) -> DataFrame:
    """New Parquet files of reads in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def processed(reads: DataFrame, config: Config) -> DataFrame:
    """A stream of single reads through all steps; adapters and tails are named, as nothing can be looked up in a stream."""
    config = config.resolved()
    if config.adapter_selection == "auto" or config.pre_trim_polyx == "auto":
        raise ValueError("adapters and poly-X bases of a stream are chosen before it starts")
    return pipeline.process_single(reads, config)


def running_counts(done: DataFrame) -> DataFrame:
    """Reads and bases by filter, for output in complete or update mode."""
    return filters.filter_counts(done)


def windowed_counts(done: DataFrame, time: str = "ts", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Reads and bases by window of an event time, closed once it is later than `late`."""
    return (done.withWatermark(time, late).groupBy(F.window(time, width), "read_type")
            .agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).alias("bases")))

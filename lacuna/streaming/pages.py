"""New cached pages as a stream: each becomes works in a growing table as it lands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.corpus import normalise_pages
from lacuna.sources.schema import PAGE


def page_stream(spark: SparkSession, raw_dir: str, files_per_trigger: int = 100) -> DataFrame:
    """(page, meta, results) of pages in ``raw_dir`` and of those that come; the file source remembers what it has read."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "page-*.json").load(raw_dir)
    page = F.regexp_extract(F.input_file_name(), r"page-(\d+)\.json$", 1).cast("int")
    return raw.select(page.alias("page"), F.from_json("value", PAGE).alias("b")).select("page", "b.*")


def land(spark: SparkSession, raw_dir: str, out_dir: str, checkpoint_dir: str):
    """Append the works of new pages to ``out_dir`` as Parquet, all that there is now, exactly once; ends when done."""
    works = normalise_pages(page_stream(spark, raw_dir))
    return works.writeStream.format("parquet").option("checkpointLocation", checkpoint_dir).outputMode("append").trigger(availableNow=True).start(out_dir)

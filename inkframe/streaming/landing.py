"""Detection documents that land in a folder: each page is taken once, late copies are dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkframe.sources.readers import DETECTIONS

#: Suffixes of page images that are accepted.
SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")


def landed_pages(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """A stream of (image, width, height, detections, landed); a page that lands again within ``delay`` is dropped."""
    files = spark.readStream.schema(DETECTIONS).option("multiLine", True).json(folder)
    pages = files.select(F.explode("images").alias("i"), F.current_timestamp().alias("landed")).select("i.*", "landed")
    known = pages.filter(F.lower(F.element_at(F.split("image", r"\."), -1)).isin(*SUFFIXES))
    return known.withWatermark("landed", delay).dropDuplicatesWithinWatermark(["image"])


def unique_names(images: DataFrame, key: str, order: str) -> DataFrame:
    """File names of an upload: a name that occurs again gets ``_1``, ``_2``, ... before its suffix."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    stem, suffix = F.regexp_extract(key, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(key, r"^(.*?)(\.[^.]*)?$", 2)
    return images.withColumn("stored", F.when(n == 0, F.col(key)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), suffix)))


def run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand batches to ``handle(frame, number)``; with a checkpoint folder a restarted run continues where it stopped."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Incremental pipelines on Structured Streaming: file scans, timelines with late data, thread states, crawl frontiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from subjectlens.functions.values import status_of_class
from subjectlens.operators.merge import matched_mail
from subjectlens.operators.tables import written


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    """ST1: new Parquet files of a folder; the query's checkpoint remembers those that were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Handles all that is there batch by batch, then stops. A batch that is run again has the same number."""
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start().awaitTermination()


def daily_timeline(events: DataFrame, late: str = "2 days") -> DataFrame:
    """ST8: rows per day; days are closed once the watermark has passed them. Works on batch and stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n")


def run_updates(stream: DataFrame, checkpoint: str, key: list[str], path: str) -> None:
    """Writes what each batch changes to path/batch=n; a batch that is run again replaces itself."""
    each = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
    stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start().awaitTermination()


def inbox_updates(mail: DataFrame, requests: DataFrame) -> DataFrame:
    """ST2: (mail_id, request_id, status) of mail(id, sender, label): matched to requests, with the status its class leads to.

    Mail that matches nothing has no row. For a stream of mail this runs on each batch, by run_available.
    """
    found = matched_mail(mail, requests).join(mail.select(F.col("id").alias("mail_id"), "label"), "mail_id")
    return found.select("mail_id", "request_id", status_of_class(F.col("label")).alias("status"))


def progress_of(items: DataFrame, key: str, done: Column, *order: Column) -> DataFrame:
    """ST5: items with the share of their key's items that are done up to each, in order."""
    whole = F.count("*").over(W.partitionBy(key))
    upto = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("progress", F.count_if(done).over(upto) / whole)


def frontier(links: DataFrame, seeds: DataFrame, depth: int = 2, most: int | None = None) -> DataFrame:
    """ST3, ST4: (url, depth) of what links(src, dst) reach from seeds(url) in at most `depth` steps, each at its first depth.

    With `most`, the crawl stops after so many pages, first come, first served: a page comes where its earliest link
    stands on the earliest page that links to it. `place`, where seeds and links have it, says where; else the address does. An
    arrival is the list of places on the way, as long as the depth, so pages need no common count.
    """
    placed = lambda df, c: df.select(*[x for x in df.columns if x in ("src", "dst", "url")], F.struct((F.col("place").cast("long") if "place" in df.columns else F.lit(0).cast("long")).alias("place"), F.col(c).alias("name")).alias("step"))
    links = placed(links, "dst")
    seen = placed(seeds, "url").groupBy("url").agg(F.array(F.min("step")).alias("came")).select("url", F.lit(0).alias("depth"), "came")
    front = seen
    for d in range(1, depth + 1):
        step = links.join(front.select(F.col("url").alias("src"), "came"), "src").select(F.col("dst").alias("url"), F.concat("came", F.array("step")).alias("came"))
        first = step.groupBy("url").agg(F.min("came").alias("came")).join(seen.select("url"), "url", "left_anti")
        front = written(first.select("url", F.lit(d).alias("depth"), "came"), "frontier")
        seen = seen.unionByName(front)
    return (seen if most is None else seen.orderBy("depth", "came").limit(most)).select("url", "depth")

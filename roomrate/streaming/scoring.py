"""Request scoring, batch or stream (M14, with S4, F13, F14, F15).

score(requests) = decode JSON -> defaults -> (text present and non-empty ? text-model bin :
default bin) -> main model -> {"pred_price_year_avg": "<str>"}.

Stateless and row-wise (no shuffle), so the same function runs over a batch
table or a Structured Streaming source. The stream helpers read JSON-bearing
parquet files with a glob filter and drain them with `availableNow`, writing
to a parquet sink + checkpoint in the shared folder. Sink and checkpoint are the
caller's, and stay: a later run takes the files that came since, and a run that
follows a killed one does the unfinished batch again. The sink's own log says
which files are its output, so each request is there once. Requests that do not
decode go, with the reason, to a dead-letter sink by a stream of their own.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomrate.sources.json_io import decode_requests, encode_response


def text_bin(text: Column, predicted: Column, default: Column) -> Column:
    """The text model's bin where there is text (empty text is none), else the default bin."""
    return F.when(has_text(text), predicted).otherwise(default)


def has_text(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def score(requests: DataFrame, main_model: PipelineModel, text_model: PipelineModel | None = None,
          body: str = "body", description: str = "description", defaults: dict | None = None) -> DataFrame:
    """requests(request_id, body[, description]) -> (request_id, is_valid, prediction, response, bin_source).

    The description comes from the JSON body, or else from a `description` column of
    the request table. Empty text keeps the default bin (falsy text in the source)."""
    ext = description if description in requests.columns else None
    dec = decode_requests(requests.withColumnRenamed(ext, "_desc_ext") if ext else requests, body,
                          defaults=defaults, keep=("request_id", "_desc_ext") if ext else ("request_id",))
    if ext:
        dec = dec.withColumn("description", F.coalesce(F.col("description"), F.col("_desc_ext"))).drop("_desc_ext")
    dec = dec.withColumn("bin_source", F.lit("default"))
    if text_model is not None:
        text = F.col("description")
        scored_text = text_model.transform(dec.withColumn("_text", F.coalesce(F.col("description"), F.lit(""))))
        dec = scored_text.select(*[F.col(c) for c in dec.columns if c not in ("pred_price_year_avg_bin", "bin_source")],
                                 F.when(has_text(text), F.lit("text")).otherwise(F.lit("default")).alias("bin_source"),
                                 text_bin(text, F.col("_pred").cast("int"), F.col("pred_price_year_avg_bin")).alias("pred_price_year_avg_bin"))
    out = main_model.transform(dec)
    return out.select("request_id", "is_valid", F.col("prediction"),
                      encode_response(F.col("prediction")).alias("response"), "bin_source")


def score_stream(spark: SparkSession, source_dir: str, glob: str, schema, to_requests, main_model: PipelineModel,
                 sink_dir: str, checkpoint_dir: str, text_model: PipelineModel | None = None,
                 defaults: dict | None = None) -> DataFrame:
    """Drain a parquet file stream through `score` (trigger availableNow: all files that came since the last run) and
    return the sink as a table."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source_dir)
    return drained(score(to_requests(stream), main_model, text_model, defaults=defaults), sink_dir, checkpoint_dir)


def rejected(requests: DataFrame, body: str = "body") -> DataFrame:
    """(request_id, reason, body) of the requests that do not decode."""
    told = decode_requests(requests.withColumn("_body", F.col(body)), body, keep=("request_id", "_body")).where("not is_valid")
    return told.select("request_id", F.coalesce(F.array_join("rejects", "|"), F.lit("not a JSON object")).alias("reason"),
                       F.col("_body").alias("body"))


def reject_stream(spark: SparkSession, source_dir: str, glob: str, schema, to_requests, sink_dir: str, checkpoint_dir: str) -> DataFrame:
    """Drain the same file stream through `rejected` into the dead-letter sink, and return that as a table."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source_dir)
    return drained(rejected(to_requests(stream)), sink_dir, checkpoint_dir)


def drained(stream: DataFrame, sink_dir: str, checkpoint_dir: str) -> DataFrame:
    """Append what waits in a stream to a parquet sink; the sink as a table."""
    q = (stream.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink_dir)


"""Registered queries: sources and sinks (S1-S5) and request decoding.

Round-trip queries write Spark-derived copies of driver tables into the shared
checkpoint folder (never a machine-local temp folder) and read them back with
the library's readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomrate import constants as K
from roomrate.operators.models import fit_regression
from roomrate.operators.profile import column_means
from roomrate.plans.common import r, round_doubles, tables
from roomrate.plans.registry import register
from roomrate.session import shared_path
from roomrate.sources import csv_io, json_io, model_store
from roomrate.sources.bindings import REQUESTS_SQL, requests_from_events
from roomrate.streaming.scoring import reject_stream, rejected

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType())])


@register("csv_roundtrip_text", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_csv_text(spark, sf_dir):
    """Gzip CSV with quoted multi-line free text, header, explicit schema."""
    path = csv_io.write_csv(tables(spark, sf_dir).documents.select(*DOC_SCHEMA.fieldNames()),
                            shared_path(spark, "roundtrip", "documents_csv"))
    return csv_io.read_csv(spark, path, DOC_SCHEMA)


ORDERS_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType())])


@register("csv_roundtrip_dates", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, "
                                 "o_orderpriority FROM orders")
def q_csv_dates(spark, sf_dir):
    """CSV with a parsed date-time column."""
    path = csv_io.write_csv(tables(spark, sf_dir).orders, shared_path(spark, "roundtrip", "orders_csv"), compression="none")
    return csv_io.read_csv(spark, path, ORDERS_SCHEMA, multi_line=False)


_PART_MEAN_COLS = ("p_partkey", "p_size", "p_retailprice")


@register("json_profile_roundtrip",
          "SELECT " + ", ".join(r(f"avg({c})", c) for c in _PART_MEAN_COLS) + " FROM part")
def q_json_profile(spark, sf_dir):
    """S3: one-row profile written as a JSON object and read back."""
    prof = column_means(tables(spark, sf_dir).part, _PART_MEAN_COLS)
    path = json_io.write_profile(prof, shared_path(spark, "profiles", "part_means"))
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in _PART_MEAN_COLS])
    return round_doubles(json_io.read_profile(spark, path, schema))


def _decoded(spark, sf_dir):
    return json_io.decode_requests(requests_from_events(tables(spark, sf_dir).events))


def _field_sql(name: str, typ: str, default) -> str:
    sql_t = {"int": "INTEGER", "double": "DOUBLE"}[typ]
    raw = f"json_extract_string(body, '$.{name}')"
    return f"COALESCE(TRY_CAST({raw} AS {sql_t}), CAST({default} AS {sql_t}))", \
           f"({raw} IS NOT NULL AND TRY_CAST({raw} AS {sql_t}) IS NULL)"


_DEFAULTS = {n: (t, d) for n, t, d in K.request_fields()}


def request_sql(extra: str = "") -> str:
    """Decoded requests: request_id, all fields with their defaults, is_valid."""
    fields, bads = [], []
    for n, (t, d) in _DEFAULTS.items():
        val, bad = _field_sql(n, t, d)
        fields.append(f"CASE WHEN json_valid(body) THEN {val} ELSE CAST({d} AS {'INTEGER' if t == 'int' else 'DOUBLE'}) END AS {n}")
        bads.append(bad)
    valid = f"(json_valid(body) AND NOT ({' OR '.join(bads)}))"
    return f"SELECT request_id, {extra + ', ' if extra else ''}{', '.join(fields)}, CASE WHEN json_valid(body) THEN {valid} ELSE FALSE END AS is_valid FROM ({REQUESTS_SQL}) q"


@register("request_defaults", request_sql())
def q_request_defaults(spark, sf_dir):
    """F13 + F14: typed decode, per-field defaults for all 138 fields, validity flag."""
    return _decoded(spark, sf_dir).drop("description", "rejects")


_REJECTS_SQL = ("concat_ws('|', " + ", ".join(f"CASE WHEN {_field_sql(n, t, d)[1]} THEN '{n}' END" for n, (t, d) in _DEFAULTS.items()) + ")")


@register("request_rejects", f"""
SELECT request_id, CASE WHEN json_valid(body) THEN {_REJECTS_SQL} ELSE 'not a JSON object' END AS reason
FROM ({REQUESTS_SQL}) q WHERE NOT json_valid(body) OR {_REJECTS_SQL} <> ''
""")
def q_request_rejects(spark, sf_dir):
    """S4 + F13: requests that do not decode, with the fields that are badly typed."""
    return rejected(requests_from_events(tables(spark, sf_dir).events)).drop("body")


@register("rejected_requests_stream", f"""
SELECT request_id, CASE WHEN json_valid(body) THEN {_REJECTS_SQL} ELSE 'not a JSON object' END AS reason, body
FROM ({REQUESTS_SQL}) q WHERE NOT json_valid(body) OR {_REJECTS_SQL} <> ''
""")
def q_rejected_stream(spark, sf_dir):
    """M14 + S4: the dead-letter sink of the request stream, read back. Sink and checkpoint are kept by the state of
    the input files: another run over the same files adds nothing."""
    base = shared_path(spark, "streams", "rejected", model_store.input_stamp(spark, sf_dir), unique=False)
    schema = tables(spark, sf_dir).events.schema
    return reject_stream(spark, sf_dir, "events.parquet", schema, requests_from_events, base + "/sink", base + "/checkpoint")


@register("request_response_json", f"""
SELECT request_id, to_json({{'accommodates': accommodates, 'bedrooms': bedrooms, 'bathrooms': bathrooms}}) AS response
FROM ({request_sql()}) d
""")
def q_request_json(spark, sf_dir):
    """Request decode + JSON encode of the completed feature subset."""
    d = _decoded(spark, sf_dir)
    return d.select("request_id", F.to_json(F.struct("accommodates", "bedrooms", "bathrooms")).alias("response"))


@register("model_save_load", "SELECT l_orderkey, l_linenumber, TRUE AS loaded_alike FROM lineitem")
def q_model_save_load(spark, sf_dir):
    """Fit, save (never overwriting), load, score: the loaded model predicts what the fitted one does."""
    li = tables(spark, sf_dir).lineitem
    model = fit_regression(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "lr")
    loaded = model_store.load_model(model_store.save_model(spark, model, "lineitem_price"))
    first = model.transform(li).withColumnRenamed("prediction", "own").drop("features")
    return loaded.transform(first).select("l_orderkey", "l_linenumber", (F.col("own") == F.col("prediction")).alias("loaded_alike"))

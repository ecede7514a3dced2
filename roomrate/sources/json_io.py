"""JSON profile sink and score-request codec.

* The default profile is a one-row aggregate written as one JSON object.
* A score request is a partial JSON object: typed decode with `from_json`
  (PERMISSIVE: a bad field becomes NULL), a validity flag so bad values are
  not silently defaulted, then per-field defaults with `coalesce`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomrate import constants as K

_TYPES = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def write_profile(profile: DataFrame, path: str) -> str:
    """Write a one-row profile as a single JSON object (one part file)."""
    profile.coalesce(1).write.mode("errorifexists").json(path)
    return path


def write_profile_rows(profile: DataFrame, path: str) -> str:
    """Write (feature, value) rows as a single JSON object, features in order (an object is one value: one row)."""
    entries = F.array_sort(F.collect_list(F.struct("feature", "value")))
    profile.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.mode("errorifexists").text(path)
    return path


def read_profile(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def request_schema(fields=None, with_description: bool = True) -> T.StructType:
    fields = fields if fields is not None else K.request_fields()
    out = [T.StructField("description", T.StringType(), True)] if with_description else []
    out += [T.StructField(n, _TYPES[t], True) for n, t, _ in fields]
    return T.StructType(out)


def decode_requests(df: DataFrame, body: str = "body", fields=None, defaults: dict | None = None,
                    keep: tuple = ("request_id",)) -> DataFrame:
    """JSON body -> typed feature columns with defaults, plus `is_valid` and `rejects`.

    The body is parsed ONCE into map<string,string>: the map is a column of its own, which the optimizer does not
    repeat in the projections that read it. Each field is then cast on its own (`try_cast`), so one bad field does not
    blank the others. `rejects` names the present fields that do not parse as their declared type, in the fields'
    order; NULL when the body is not a JSON object. is_valid is false unless rejects is empty. Invalid fields still
    take their default, so callers decide whether to drop flagged rows."""
    fields = fields if fields is not None else K.request_fields()
    dflt = {n: d for n, _, d in fields} | (defaults or {})
    kept = [k for k in keep if k in df.columns]
    kv = F.col("_kv")
    parsed = df.select(*kept, F.from_json(F.col(body), T.MapType(T.StringType(), T.StringType())).alias("_kv"))
    typed = parsed.select(*kept, "_kv", F.try_element_at(kv, F.lit("description")).alias("description"),
                          *[F.try_element_at(kv, F.lit(n)).try_cast(_TYPES[t]).alias(n) for n, t, _ in fields])
    rejects = rejected_fields(kv, fields)
    return typed.select(*kept, "description", *[F.coalesce(F.col(n), F.lit(dflt[n]).cast(_TYPES[t])).alias(n) for n, t, _ in fields],
                        F.coalesce(F.size(rejects) == 0, F.lit(False)).alias("is_valid"), rejects.alias("rejects"))


def rejected_fields(kv: Column, fields) -> Column:
    """Names of the entries of a map<string,string> that do not parse as their field's type, in the fields' order;
    only the entries that are there are looked at."""
    place = F.create_map(*[F.lit(x) for i, (n, _, _) in enumerate(fields) for x in (n, i)])

    def bad(e):
        kinds = [F.when(F.array_contains(F.array(*[F.lit(n) for n, t, _ in fields if t == kind]), e["key"]), e["value"].try_cast(_TYPES[kind]).isNull())
                 for kind in dict.fromkeys(t for _, t, _ in fields)]
        return e["value"].isNotNull() & F.coalesce(*kinds, F.lit(False))

    found = F.transform(F.filter(F.map_entries(kv), bad), lambda e: F.struct(F.element_at(place, e["key"]).alias("at"), e["key"].alias("name")))
    return F.array_sort(found)["name"]


def encode_response(pred: Column, name: str = "pred_price_year_avg") -> Column:
    """{"pred_price_year_avg": "<str>"} as a JSON string."""
    return F.to_json(F.struct(pred.cast("string").alias(name)))

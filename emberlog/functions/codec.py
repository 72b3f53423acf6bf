"""JSON text to entries and back, with the type strictness of a typed decoder.

Each value is parsed once into a VARIANT. A field of the wrong JSON type, or a timestamp that is not
RFC 3339, rejects the entry; unknown fields are ignored; JSON null leaves a field at its zero value.
Duplicate keys inside one object reject the entry, and key matching is case-sensitive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.timefmt import parse_rfc3339, rfc3339_micros
from emberlog.schema import LOG_SCHEMA

TEXT_FIELDS = ("id", "timestamp", "source", "level", "message", "trace_id", "span_id")

_TEXTS = ",".join(f"{f}:string" for f in TEXT_FIELDS)
_KINDS = ",".join(f"{f}:variant" for f in TEXT_FIELDS)
# An object cast to these: its fields as text, and as they are. Null when it is not an object.
AS_TEXT = f"struct<{_TEXTS},labels:map<string,variant>>"
AS_FOUND = f"struct<{_KINDS},labels:variant>"


def _text_like(v: Column) -> Column:
    """True for a JSON string, JSON null or an absent field: a number would cast to text, so the
    stored type is looked at."""
    return F.coalesce(F.schema_of_variant(v).isin("STRING", "VOID"), F.lit(True))


def _views(v: Column) -> Column:
    """Both casts of the object, and whether it is JSON null instead (an entry of zero values)."""
    return F.struct(
        F.try_variant_get(v, "$", AS_TEXT).alias("text"),
        F.try_variant_get(v, "$", AS_FOUND).alias("found"),
        F.is_variant_null(v).alias("nothing"))


def _acceptable(views: Column, stamp: Column) -> Column:
    """Is this an entry; `stamp` is its parsed timestamp."""
    text, found = views["text"], views["found"]
    ok = found.isNotNull() & (text["timestamp"].isNull() | stamp.isNotNull())
    for f in TEXT_FIELDS:
        ok = ok & _text_like(found[f])
    flat = F.forall(F.map_values(text["labels"]), _text_like)
    no_labels = found["labels"].isNull() | F.is_variant_null(found["labels"])
    ok = ok & (no_labels | F.coalesce(flat, F.lit(False)))
    return views["nothing"] | F.coalesce(ok, F.lit(False))


def _values(text: Column, stamp: Column) -> dict[str, Column]:
    """The entry's columns by name."""
    labels = F.transform_values(
        text["labels"], lambda _, x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
    parts = {f: text[f] for f in TEXT_FIELDS} | {"timestamp": stamp, "labels": labels}
    return {f: parts[f] for f in LOG_SCHEMA.fieldNames()}


def _settled_here(value: Column) -> Column:
    """The same value, made non-deterministic (a random number is never negative): a later filter on it
    is then evaluated above this projection, instead of being pushed below, where it would repeat the
    parsing in its condition."""
    return F.when(F.rand(0) * 2 >= 0, value)


def decode_one(df: DataFrame, value: str, allow_trailing: bool = False) -> tuple[DataFrame, Column, dict[str, Column]]:
    """The rows with working columns added, a column that says whether the text is one acceptable
    entry, and the entry's columns by name (of use only where it is).

    Text after the entry is an error unless `allow_trailing` (a request body reader stops after the
    first value, a stream record must be exactly one). The steps are projections of their own, so
    each text is parsed and cast once.
    """
    kept = df.columns
    if allow_trailing:
        parsed = df.withColumn("_v", F.try_parse_json(value))
    else:
        # Inside brackets anything but exactly one value fails to parse or gives another count.
        listed = df.withColumn("_v", F.try_parse_json(F.concat(F.lit("["), F.col(value), F.lit("]"))))
        alone = F.try_variant_get("_v", "$[1]", "variant").isNull()
        parsed = listed.withColumn("_v", F.when(alone, F.try_variant_get("_v", "$[0]", "variant")))
    viewed = parsed.select(*kept, _views(F.col("_v")).alias("_views"))
    stamped = viewed.withColumn("_stamp", parse_rfc3339(F.col("_views.text.timestamp")))
    ok = _acceptable(F.col("_views"), F.col("_stamp"))
    judged = stamped.select(
        *kept, F.col("_views.text").alias("_text"), "_stamp", _settled_here(ok).alias("_ok"))
    return judged, F.col("_ok"), _values(F.col("_text"), F.col("_stamp"))


def _element(views: Column) -> Column:
    """Struct of one entry inside an array, null when it is rejected."""
    stamp = parse_rfc3339(views["text"]["timestamp"])
    parts = _values(views["text"], stamp)
    return F.when(_acceptable(views, stamp), F.struct(*[c.alias(f) for f, c in parts.items()]))


def decode_array(df: DataFrame, value: str) -> DataFrame:
    """Add `entries`: the decoded elements of the JSON array in the text, null unless all are acceptable.

    JSON null is an empty array; text after the array is ignored.
    """
    kept = df.columns
    parsed = df.withColumn("_v", F.try_parse_json(value))
    viewed = parsed.select(
        *kept, F.is_variant_null("_v").alias("_nothing"),
        F.transform(F.try_variant_get("_v", "$", "array<variant>"), _views).alias("_views"))
    decoded = viewed.withColumn("_all", F.transform("_views", _element))
    none = F.array().cast(f"array<{LOG_SCHEMA.simpleString()}>")
    whole = F.when(F.col("_nothing"), none).when(~F.exists("_all", lambda e: e.isNull()), F.col("_all"))
    return decoded.select(*kept, _settled_here(whole).alias("entries"))


def encode_entry() -> Column:
    """JSON text of the entry columns: the first five fields always, the optional ones when not empty."""
    def always(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    def optional(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name)).alias(name)

    return F.to_json(F.struct(
        always("id"),
        rfc3339_micros(F.col("timestamp")).alias("timestamp"),
        always("source"),
        always("level"),
        always("message"),
        F.when(F.size("labels") > 0, F.col("labels")).alias("labels"),
        optional("trace_id"),
        optional("span_id"),
    ))

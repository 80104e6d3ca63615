"""Typed document values: reading them and casting them to column types.

A document field arrives as a one-key object naming its type, for example
``{"integerValue": "42"}``.  Each branch is read as text, so one JSON parse with
a fixed schema covers every type and the casts below run in generated code.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.scalars import iso_text, parse_instant, parse_number, truncate_to_long

BRANCHES = [
    "nullValue", "booleanValue", "integerValue", "doubleValue", "timestampValue", "stringValue",
    "bytesValue", "referenceValue", "geoPointValue", "arrayValue", "mapValue",
]
_SCALAR_BRANCHES = ["booleanValue", "integerValue", "doubleValue", "stringValue", "referenceValue"]
# The branches that matter to a column type; the others are not even parsed.
_READ_BRANCHES = {
    "FLOAT64": _SCALAR_BRANCHES + ["bytesValue"],
    "INT64": _SCALAR_BRANCHES + ["timestampValue", "bytesValue"],
    "TIMESTAMP": _SCALAR_BRANCHES + ["timestampValue"],
    "BOOL": BRANCHES[1:],
    "STRING": BRANCHES[1:],
    "JSON": BRANCHES[1:],
}


def value_schema(kind: str) -> T.StructType:
    """JSON schema of one typed value that goes into a column of this type."""
    return T.StructType([T.StructField(b, T.StringType()) for b in _READ_BRANCHES[kind]])

_TRUE_WORDS = ["true", "1", "yes", "y"]
# A number larger than this is a count of microseconds, a smaller one of seconds.
MICROS_ABOVE = 1e12

# A value has one branch, so branches that are cast alike are coalesced first
# and cast once.


def _boolean(value: Column) -> Column:
    return value["booleanValue"].try_cast("boolean")


def _integer(value: Column) -> Column:
    return value["integerValue"].try_cast("bigint")


def _whole(value: Column) -> Column:
    """The integer branch as text, if it is a whole number."""
    return F.when(_integer(value).isNotNull(), value["integerValue"])


def _text(value: Column) -> Column:
    return F.coalesce(value["stringValue"], value["referenceValue"])


def _bytes(value: Column) -> Column:
    """The decoded bytes; NULL if they are malformed."""
    return F.try_to_binary(value["bytesValue"], F.lit("base64"))


def _number(value: Column) -> Column:
    """Any numeric branch, or text or bytes that read as a number."""
    return parse_number(
        F.coalesce(
            value["doubleValue"], _whole(value), value["stringValue"], value["referenceValue"],
            _bytes(value).cast("string"),
        )
    )


def float_text(number: Column) -> Column:
    """A double in its shortest spelling: plain from 1e-4 to below 1e16, else with an exponent."""
    size = F.abs(number)
    short = number.cast("string")
    plain = F.regexp_replace(short.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.regexp_extract(short, "^([^E]*)", 1), r"\.0$", "")
    power = F.regexp_extract(short, "E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    scientific = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return (
        F.when(F.isnan(number), "nan")
        .when(size == float("inf"), F.when(number > 0, "inf").otherwise("-inf"))
        .when(number == 0.0, short)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def _double(value: Column) -> Column:
    return parse_number(value["doubleValue"])


def nested_value(value: Column) -> Column:
    """JSON text of a value whose reading needs more than a cast: bytes, points, arrays and maps."""
    def wrapped(branch: str) -> Column:
        return F.when(value[branch].isNotNull(), F.concat(F.lit('{"' + branch + '":'), value[branch], F.lit("}")))

    raw = F.when(value["bytesValue"].isNotNull(), F.to_json(F.struct(value["bytesValue"].alias("bytesValue"))))
    return F.coalesce(raw, *[wrapped(b) for b in ("geoPointValue", "arrayValue", "mapValue")])


def _instant(value: Column) -> Column:
    return parse_instant(
        F.coalesce(value["timestampValue"], value["stringValue"], value["referenceValue"])
    )


def to_string(value: Column, nested: Column | None = None) -> Column:
    """Text as it is, other values as they are spelled, nested ones as JSON of their plain form."""
    return F.coalesce(
        _text(value),
        F.initcap(_boolean(value).cast("string")),
        _integer(value).cast("string"),
        float_text(_double(value)),
        iso_text(parse_instant(value["timestampValue"])),
        plain_text(nested_value(value)) if nested is None else nested,
    )


def _quoted(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def to_json_text(value: Column, nested: Column | None = None) -> Column:
    """JSON of the plain value; text stands as it is."""
    number = _double(value)
    spelled = float_text(number)
    special = F.when(F.isnan(number), "NaN").when(spelled == "inf", "Infinity").when(spelled == "-inf", "-Infinity")
    moment = F.replace(iso_text(parse_instant(value["timestampValue"])), F.lit("T"), F.lit(" "))
    nested = plain_text(nested_value(value)) if nested is None else nested
    return F.coalesce(
        _text(value),
        _boolean(value).cast("string"),
        _integer(value).cast("string"),
        special, spelled,
        _quoted(moment),
        F.when(value["bytesValue"].isNotNull(), _quoted(nested)).otherwise(nested),
    )


def to_int64(value: Column) -> Column:
    """Whole number, fraction dropped; unreadable or infinite gives NULL."""
    return F.coalesce(
        truncate_to_long(_number(value)),
        _boolean(value).cast("bigint"),
        F.unix_micros(parse_instant(value["timestampValue"])),
    )


def to_float64(value: Column) -> Column:
    return F.coalesce(_number(value), _boolean(value).cast("int").cast("double"))


def to_bool(value: Column) -> Column:
    """Text is true only for a few words; other values by being non-zero."""
    numeric = parse_number(F.coalesce(value["doubleValue"], _whole(value)))
    members = F.get_json_object(value["mapValue"], "$.fields")
    return F.coalesce(
        F.lower(F.trim(_text(value))).isin(_TRUE_WORDS),
        _boolean(value),
        numeric != 0.0,
        F.octet_length(_bytes(value)) > 0,
        F.when(value["geoPointValue"].isNotNull(), F.lit(True)),
        F.when(value["arrayValue"].isNotNull(),
               F.coalesce(F.json_array_length(F.get_json_object(value["arrayValue"], "$.values")) > 0, F.lit(False))),
        F.when(value["mapValue"].isNotNull(), F.coalesce(F.size(F.json_object_keys(members)) > 0, F.lit(False))),
        F.when(parse_instant(value["timestampValue"]).isNotNull(), F.lit(True)),
    )


def to_timestamp(value: Column) -> Column:
    number = F.coalesce(
        parse_number(F.coalesce(value["doubleValue"], _whole(value))),
        _boolean(value).cast("int").cast("double"),
    )
    scale = F.when(F.abs(number) > MICROS_ABOVE, 1.0).otherwise(1_000_000.0)
    return F.coalesce(_instant(value), F.timestamp_micros(truncate_to_long(number * scale)))


_CASTS = {
    "STRING": to_string, "INT64": to_int64, "FLOAT64": to_float64, "BOOL": to_bool,
    "TIMESTAMP": to_timestamp, "JSON": to_json_text,
}


# Kinds in which a nested value has a text.
TEXT_KINDS = ("STRING", "JSON")


def coerce_column(value: Column, kind: str, nested: Column | None = None) -> Column:
    """Lossy cast of a typed value to a column type; NULL instead of an error.

    ``nested`` is ``plain_text(nested_value(value))`` where the caller has it already.
    """
    cast = _CASTS[kind]
    result = cast(value, nested) if kind in TEXT_KINDS else cast(value)
    return F.when(value.isNotNull(), result)


# --- whole documents --------------------------------------------------------


# The usual spelling of an instant; what reads otherwise goes the long way.
_UTC_INSTANT = re.compile(r"(?:1[89]|20|21)[0-9]{2}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z")


def _instant_text(raw: str) -> str | None:
    if isinstance(raw, str) and _UTC_INSTANT.fullmatch(raw):
        try:
            return str(datetime.fromisoformat(raw[:-1])) + "+00:00"
        except ValueError:
            pass
    try:
        stamp = pd.Timestamp(raw.strip())
    except (ValueError, AttributeError):
        return None
    if stamp is pd.NaT:
        return None
    stamp = stamp.tz_localize("UTC") if stamp.tzinfo is None else stamp.tz_convert("UTC")
    return str(stamp.floor("us").to_pydatetime(warn=False))


def _converted(raw, convert):
    try:
        return convert(raw)
    except (TypeError, ValueError):
        return None


def _bytes_text(raw) -> str | None:
    try:
        return str(base64.b64decode(raw))
    except Exception:  # malformed bytes read as NULL
        return None


_READERS = {
    "nullValue": lambda v: None,
    "booleanValue": bool,
    "integerValue": lambda v: _converted(v, int),
    "doubleValue": lambda v: _converted(v, float),
    "timestampValue": _instant_text,
    "stringValue": lambda v: v,
    "bytesValue": _bytes_text,
    "referenceValue": lambda v: v,
    "geoPointValue": lambda v: {
        axis: (v or {}).get(axis, 0.0) for axis in ("latitude", "longitude")
    },
    "arrayValue": lambda v: [plain_value(item) for item in (v or {}).get("values", [])],
    "mapValue": lambda v: plain_fields((v or {}).get("fields")),
}


def plain_value(value):
    """One typed value as a plain one; an unknown wrapper stays as it is."""
    if isinstance(value, dict):
        if len(value) == 1:
            for branch, content in value.items():
                reader = _READERS.get(branch)
                return value if reader is None else reader(content)
        for branch in BRANCHES:
            if branch in value:
                return _READERS[branch](value[branch])
    return value


def plain_fields(fields) -> dict:
    return {name: plain_value(value) for name, value in (fields or {}).items()}


@F.pandas_udf(T.StringType())
def decode_document(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON text of a typed fields map to JSON text of the plain document.

    Documents nest to any depth, which a column expression cannot follow; this
    is the one place rows are visited in Python, in Arrow batches.
    """

    def decode(text):
        if text is None:
            return "{}"
        try:
            return json.dumps(plain_fields(json.loads(text)))
        except (ValueError, AttributeError, TypeError):
            return None

    for batch in batches:
        yield pd.Series([decode(text) for text in batch], dtype=object)


def _plain_text(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        value = plain_value(json.loads(text))
    except (ValueError, AttributeError, TypeError):
        return None
    return value if value is None or isinstance(value, str) else json.dumps(value, default=str)


@F.pandas_udf(T.StringType())
def plain_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of nested typed values in their plain form; NULL for NULL."""
    for batch in batches:
        yield batch.map(_plain_text, na_action=None).astype(object)


@F.arrow_udf(T.ArrayType(T.StringType()))
def plain_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same for the nested values of all columns of a row at once; NULL where a row has none.

    Only the values that are there become Python objects: nearly all are NULL.
    """
    for rows in batches:
        values = pc.list_flatten(rows)
        there = pc.is_valid(values)
        plain = pa.array([_plain_text(text) for text in values.filter(there).to_pylist()], pa.string())
        nth = pc.subtract(pc.cumulative_sum(there.cast(pa.int64())), 1) if len(values) else pa.array([], pa.int64())
        values = plain.take(pc.if_else(there, nth, pa.scalar(None, pa.int64())))
        sizes = pc.fill_null(pc.list_value_length(rows), 0).cast(pa.int32())
        ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pc.is_null(rows))

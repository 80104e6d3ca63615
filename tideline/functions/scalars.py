"""Small column expressions shared by the operators.

Everything here builds a Column from Columns, so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes accepted as an ISO-8601 / RFC 3339 instant or date.
_ISO_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)
# Number literals of the JVM that are not numbers elsewhere: suffixes and hex.
_JVM_NUMBER = r"[xX]|[0-9.][dDfF]\s*$"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_divide(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as a double; NULL when the denominator is zero or NULL."""
    return F.try_divide(
        as_col(numerator).cast("double"), as_col(denominator).cast("double")
    )


def money(value: Column | str) -> Column:
    return F.round(as_col(value), 2)


def exact_money(value: Column | str) -> Column:
    """Cents-exact decimal, so that sums do not depend on the order of adding."""
    return as_col(value).cast("decimal(18,2)")


def null_if_empty(value: Column | str) -> Column:
    return F.nullif(as_col(value), F.lit(""))


def parse_instant(text: Column | str) -> Column:
    """ISO-8601 text to a UTC timestamp.

    A missing zone means UTC, fractions are cut to six digits, anything else
    that is not an instant gives NULL.
    """
    trimmed = F.trim(as_col(text))
    return F.when(trimmed.rlike(_ISO_SHAPE), trimmed.try_cast("timestamp"))


def parse_number(text: Column | str) -> Column:
    """Text to a double, infinities and NaN by name included; otherwise NULL."""
    col = as_col(text)
    return F.when(~col.rlike(_JVM_NUMBER), col.try_cast("double"))


def truncate_to_long(value: Column | str) -> Column:
    """Drop the fraction towards zero; NULL when the result is no 64-bit integer."""
    return as_col(value).try_cast("bigint")


def iso_text(instant: Column | str) -> Column:
    """Timestamp to ISO text with an explicit UTC offset; fraction only if any."""
    text = F.date_format(as_col(instant), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, "[.]000000$", ""), F.lit("+00:00"))


def change_sequence(commit_time: Column | str) -> Column:
    """Microseconds since the epoch; orders the versions of one document."""
    return F.unix_micros(as_col(commit_time))


def change_sequence_hex(commit_time: Column | str) -> Column:
    """The same sequence in its lowercase hexadecimal display form."""
    return F.lower(F.hex(change_sequence(commit_time)))


def stable_hash(*parts: Column | str) -> Column:
    """First 16 hex digits of SHA-256 over the parts joined by ``|``."""
    joined = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)


def stable_bucket(modulus: int, *parts: Column | str) -> Column:
    """A repeatable bucket number, the same at any parallelism."""
    return F.conv(F.substring(stable_hash(*parts), 1, 12), 16, 10).cast("bigint") % modulus


def lookup(table: dict, key: Column, default=None) -> Column:
    """Literal map lookup with a default for keys that are not in the map."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def integer_request(column: Column | str, from_text: bool) -> Column:
    """A requested whole number: text must be an integer, numbers lose their fraction.

    Anything unreadable gives 0.
    """
    col = as_col(column)
    if from_text:
        text = F.trim(col)
        value = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    else:
        value = truncate_to_long(col.cast("double"))
    return F.coalesce(value, F.lit(0).cast("bigint"))


def is_text(df, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("string", "varchar", "char")

"""Canonical JSON of nested columns, led by their type: one text for one value, so that digests of it can be compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bound

#: Control characters with an escape of two characters; all others below the blank have six.
SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quoted(text: Column) -> Column:
    """A JSON string: quotation marks, backslashes and control characters escaped, everything else as it is."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = out
    for code in range(32):
        char = chr(code)
        escaped = F.replace(escaped, F.lit(char), F.lit(SHORT.get(char, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), escaped).otherwise(out), F.lit('"'))


def number(value: Column) -> Column:
    """The shortest digits that give a double back; exponents only from 1e16 on and below 1e-4. Null for what is no number."""

    def plain(text: Column) -> Column:
        sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
        bare = F.regexp_replace(text, "^-", "")
        mantissa, exponent = F.regexp_replace(bare, "E.*$", ""), F.coalesce(F.try_element_at(F.split(bare, "E"), F.lit(2)).cast("int"), F.lit(0))
        digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=.)0+$", "")  # of a mantissa d.ddd
        size = F.length(digits)
        fixed = (
            F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
            .when(size <= exponent + 1, F.concat(digits, F.repeat(F.lit("0"), exponent + 1 - size), F.lit(".0")))
            .otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, size)))
        )
        small = F.concat(F.substring(digits, 1, 1), F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise(""), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
        return F.when(F.contains(text, F.lit("E")), F.concat(sign, F.when((exponent < -4) | (exponent >= 16), small).otherwise(fixed))).otherwise(text)

    least = F.when(value < 0, "-5e-324").otherwise("5e-324")  # the one double of which the engine writes a digit more
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).when(F.abs(value) == 5e-324, least).otherwise(bound(value.cast("string"), plain))


def instant(value: Column) -> Column:
    """UTC with microseconds and a Z, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def encoded(value: Column, kind: T.DataType, keep_nulls: bool = True, sparse: tuple[str, ...] = ()) -> Column:
    """JSON without blanks, keys in the order of their code points, nulls as ``null`` or, in objects, left out.

    Nulls are also left out of what lies under the fields named in ``sparse``.
    Structs and maps are objects. A null text as the whole result means that there was none, or that a number in it is
    infinite or none at all. Days are ISO dates, timestamps with a time zone UTC instants; timestamps without one count as UTC.
    """
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode())
        pairs = [(f, F.concat(quoted(F.lit(f.name)), F.lit(":"), encoded(value[f.name], f.dataType, keep_nulls and f.name not in sparse, sparse))) for f in fields]
        # a null part is a null of the value, which may be left out, or something that can't be written, which may not
        parts = F.array(*(pair if keep_nulls else F.when(value[f.name].isNotNull(), pair).otherwise(F.lit("")) for f, pair in pairs)) if pairs else F.array().cast("array<string>")
        out = F.when(F.exists(parts, lambda p: p.isNull()), None).otherwise(F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda p: p != ""), ","), F.lit("}")))
    elif isinstance(kind, T.MapType):
        entry = lambda k: bound(F.element_at(value, k), lambda v: F.concat(quoted(k), F.lit(":"), encoded(v, kind.valueType, keep_nulls, sparse)) if keep_nulls else F.when(v.isNotNull(), F.concat(quoted(k), F.lit(":"), encoded(v, kind.valueType, keep_nulls, sparse))).otherwise(F.lit("")))
        out = bound(F.transform(F.array_sort(F.map_keys(value)), entry), lambda parts: F.when(F.exists(parts, lambda p: p.isNull()), None).otherwise(F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda p: p != ""), ","), F.lit("}"))))
    elif isinstance(kind, T.ArrayType):
        out = bound(F.transform(value, lambda x: encoded(x, kind.elementType, keep_nulls, sparse)), lambda parts: F.when(F.exists(parts, lambda p: p.isNull()), None).otherwise(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = number(value.cast("double"))
    elif isinstance(kind, T.TimestampType):
        out = quoted(instant(value))
    elif isinstance(kind, T.TimestampNTZType):
        out = quoted(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        out = value.cast("string")
    else:
        out = quoted(value.cast("string"))
    return F.when(value.isNull(), F.lit("null")).otherwise(out)


def canonical_json(rows: DataFrame, column: str, keep_nulls: bool = True, sparse: tuple[str, ...] = ()) -> Column:
    return encoded(F.col(column), rows.schema[column].dataType, keep_nulls, sparse)


def digests(rows: DataFrame, column: str, name: str = "digest", keep_nulls: bool = True, sparse: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the SHA-256 of a column's canonical JSON."""
    return rows.withColumn(name, F.sha2(canonical_json(rows, column, keep_nulls, sparse), 256))

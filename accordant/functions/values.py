"""Column expressions that fix how values are read, compared and written: all built-in functions, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

#: What counts as a number, an identifier, a hash and an ISO date-time.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
UUID_LOOSE = r"(?i)^[0-9a-f-]{36}$"
UUID_STRICT = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
SHA256 = r"^[a-f0-9]{64}$"
ISO_EXTENDED = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
ISO_COMPACT = r"^\d{8}(T\d{2}(\d{2}(\d{2})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
ISO_WEEK = r"^\d{4}-?W(0[1-9]|[1-4]\d|5[0-3])(-?[1-7])?$"


def text(col: Column, data_type: T.DataType | None = None) -> Column:
    """The value as text; booleans are ``True`` and ``False``."""
    if isinstance(data_type, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    return col.cast("string")


def number(col: Column, data_type: T.DataType) -> Column:
    """The value as a double; null if it isn't a number. NaN counts as null, and booleans as 0 and 1."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        value = col.cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(data_type, T.StringType):
        return F.when(col.rlike(NUMBER), F.trim(col).try_cast("double"))
    if isinstance(data_type, (*NUMERIC, T.BooleanType)):
        return col.cast("int").cast("double") if isinstance(data_type, T.BooleanType) else col.cast("double")
    return F.lit(None).cast("double")


def present(col: Column, data_type: T.DataType) -> Column:
    """Whether there is a value: neither null nor NaN."""
    return col.isNotNull() & ~F.isnan(col) if isinstance(data_type, (T.FloatType, T.DoubleType)) else col.isNotNull()


def is_iso_datetime(col: Column) -> Column:
    """Whether the text is a complete ISO 8601 date, or date and time: extended, compact or by week; false for null."""
    date = F.regexp_replace(F.substring(col, 1, 10), "[^0-9]", "")
    compact = F.substring(date, 1, 8)
    valid_day = F.try_to_date(F.concat_ws("-", F.substring(compact, 1, 4), F.substring(compact, 5, 2), F.substring(compact, 7, 2)), "yyyy-MM-dd").isNotNull()
    clock = F.regexp_extract(F.regexp_replace(col, r"(?<=[T ])(\d{2}):?(\d{2})?:?(\d{2})?", "$1:$2:$3"), r"[T ](\d{2}):(\d{2})?:(\d{2})?", 0)
    part = lambda i: F.coalesce(F.regexp_extract(clock, r"[T ](\d{2}):(\d{2})?:(\d{2})?", i).try_cast("int"), F.lit(0))
    valid_time = (part(1) < 24) & (part(2) < 60) & (part(3) < 60)
    plain = (col.rlike(ISO_EXTENDED) | col.rlike(ISO_COMPACT)) & valid_day & valid_time
    return F.coalesce(plain | col.rlike(ISO_WEEK), F.lit(False))


def starts_matching(col: Column, pattern: str) -> Column:
    """Whether the pattern matches at the start of the text."""
    return col.rlike(f"^(?:{pattern})")


def round_half_even(col: Column, digits: int) -> Column:
    return F.bround(col, digits)


def normalized_field(col: Column) -> Column:
    """Lower case; brackets of lists go; all else but letters and digits is an underscore, once, and not at the ends."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.trim(col)), F.lit("[]"), F.lit("")), "[^a-z0-9]+", "_"), F.lit("_"))


def field_aliases(col: Column) -> Column:
    """The names that a field goes by: nested facts have a long and a short prefix."""
    name = normalized_field(col)
    return F.array_distinct(F.array(name, F.regexp_replace(name, "^extracted_facts_", "fact_"), F.regexp_replace(name, "^fact_", "extracted_facts_")))


def contact_summary(owner: Column, role: Column, email: Column) -> Column:
    return F.concat_ws(" | ", *[F.nullif(c, F.lit("")) for c in (owner, role, email)])


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0))


def hash_bucket(token: Column, dimensions: int = 128) -> Column:
    """Bucket of a token by its SHA-256; dimensions have to divide 256."""
    if 256 % dimensions:
        raise ValueError("dimensions have to divide 256")
    return F.conv(F.right(F.sha2(token, 256), F.lit(2)), 16, 10).cast("int") % dimensions


def cosine_distance(left: Column, right: Column) -> Column:
    """One less the cosine, between 0 and 1; 1 if a vector has no length."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    lengths = norm(left) * norm(right)
    return F.when(lengths == 0, F.lit(1.0)).otherwise(F.least(F.greatest(1 - F.try_divide(dot, lengths), F.lit(0.0)), F.lit(1.0)))


def humanized(col: Column) -> Column:
    """Dashes and underscores become spaces and each word starts with a capital."""
    return F.initcap(F.regexp_replace(col, "[-_]+", " "))


def short_hash(col: Column, size: int = 8) -> Column:
    return F.when(F.coalesce(col, F.lit("")) == "", "--").otherwise(F.substring(col, 1, size))


def truncated_middle(col: Column, keep: int = 18) -> Column:
    edge = max(4, (keep - 3) // 2)
    return F.when(F.coalesce(F.length(col), F.lit(0)) <= keep, col).otherwise(F.concat(F.substring(col, 1, edge), F.lit("..."), F.right(col, F.lit(edge))))


def normalized_path(col: Column) -> Column:
    return F.replace(F.coalesce(col, F.lit("")), F.lit("\\"), F.lit("/"))


def formatted_number(col: Column) -> Column:
    return F.when(col.isNull(), "--").otherwise(F.format_number(col, 0))


def formatted_percent(col: Column, digits: int = 1) -> Column:
    return F.when(col.isNull() | F.isnan(col.cast("double")), "--").otherwise(F.format_string(f"%.{digits}f%%", col.cast("double")))


def formatted_date(col: Column) -> Column:
    return F.coalesce(F.date_format(col, "MMM d, yyyy, h:mm a"), F.lit("Not available"))


def severity_tone(col: Column) -> Column:
    value = F.upper(F.coalesce(col, F.lit("")))
    return (
        F.when(value.isin("CRITICAL", "FAIL", "BLOCK"), "danger")
        .when(value.isin("HIGH", "WARN"), "warning")
        .when(value.isin("MEDIUM", "AUDIT"), "info")
        .when(value.isin("LOW", "PASS", "ALLOW_WITH_AUDIT_TRAIL"), "success")
        .otherwise("neutral")
    )


def service_base_url(col: Column) -> Column:
    """The address of a model service without closing slashes and version."""
    return F.regexp_replace(F.regexp_replace(F.trim(col), "/+$", ""), "/v1$", "")

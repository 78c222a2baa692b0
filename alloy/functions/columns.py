"""Column-level contract transforms (typing, nulls, money, masking, hashing).

Everything here returns ``Column`` expressions or applies them in a single
``select`` so that Catalyst keeps the work inside whole-stage codegen.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values (must equal the reference's contracts) -------------------
# Money column name fragments cast to DECIMAL(18,4).
MONEY_NAME_PARTS = ("AMOUNT", "BALANCE", "RATE", "FEE", "PRINCIPAL", "INTEREST")
# Card-data column names that are masked or dropped.
CARD_COLUMNS = ("CARD_NUMBER", "CVV", "PAN", "FULL_ACCOUNT_NUMBER")
# Card mask prefix, followed by the last four characters.
CARD_MASK_PREFIX = "XXXX-XXXX-XXXX-"
# Default sentinel values turned into NULL; 0 stays a valid value.
DEFAULT_SENTINELS = ("-1", "9999", "N/A")
# Confidence buckets: >= 0.85 high, >= 0.65 medium, else low.
CONFIDENCE_HIGH = 0.85
CONFIDENCE_MEDIUM = 0.65
# Boolean-looking strings.
TRUE_STRINGS = ("true", "t", "yes", "y", "1")
FALSE_STRINGS = ("false", "f", "no", "n", "0")
# ---------------------------------------------------------------------------

MONEY_TYPE = T.DecimalType(18, 4)
NULL_MARK = "-"

# Engine-independent "looks like" rules (Java regex and RE2 agree on these).
ISO_TS_PATTERN = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"
NUMBER_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def confidence_bucket(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return (F.when(c >= CONFIDENCE_HIGH, F.lit("high"))
            .when(c >= CONFIDENCE_MEDIUM, F.lit("medium"))
            .otherwise(F.lit("low")))


def looks_like_timestamp(c: Column) -> Column:
    return F.trim(c).rlike(ISO_TS_PATTERN)


def looks_like_number(c: Column) -> Column:
    return F.trim(c).rlike(NUMBER_PATTERN)


def looks_like_boolean(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*TRUE_STRINGS, *FALSE_STRINGS)


def to_boolean(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return (F.when(v.isin(*TRUE_STRINGS), F.lit(True))
            .when(v.isin(*FALSE_STRINGS), F.lit(False))
            .otherwise(F.lit(None).cast("boolean")))


def to_timestamp_ntz(c: Column) -> Column:
    """ISO-looking string -> TIMESTAMP_NTZ, NULL when it does not parse (ANSI-safe)."""
    s = F.regexp_replace(F.trim(c), "T", " ")
    return F.when(looks_like_timestamp(c), F.try_to_timestamp(s)).cast("timestamp_ntz")


def to_number(c: Column) -> Column:
    return F.when(looks_like_number(c), F.trim(c)).try_cast("double")


def is_money_name(name: str) -> bool:
    """One of the name's words (parted by ``_`` or by case) is a money word or its plural."""
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)
    return any(w.upper() in MONEY_NAME_PARTS or w.upper().removesuffix("S") in MONEY_NAME_PARTS for w in words)


def money(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Cast money-named (and explicitly listed) columns to DECIMAL(18,4).

    A text column is cast only if each of its non-NULL values is a number that fits (one
    aggregate over the text columns in question); else it stays as it is."""
    named = [f for f in df.schema.fields if is_money_name(f.name) or f.name in extra]
    targets = {f.name for f in named if isinstance(f.dataType, T.NumericType)}
    texts = [f.name for f in named if isinstance(f.dataType, T.StringType)]
    if texts:
        bad = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(MONEY_TYPE).isNull()) for c in texts]).first()
        targets |= {c for c, n in zip(texts, bad, strict=True) if n == 0}
    return df.select([F.col(f.name).try_cast(MONEY_TYPE).alias(f.name) if f.name in targets
                      else F.col(f.name) for f in df.schema.fields])


def null_policy(df: DataFrame, sentinels: Iterable[str] = DEFAULT_SENTINELS,
                defaults: dict[str, object] | None = None,
                columns: Sequence[str] | None = None) -> DataFrame:
    """NULLIF for sentinel values only (empty strings and 0 stay), then COALESCE defaults.
    Numbers are compared as numbers, so -1.0 is the sentinel -1."""
    sentinels = tuple(sentinels)
    defaults = defaults or {}
    cols = set(columns) if columns is not None else {f.name for f in df.schema.fields}
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in cols and isinstance(f.dataType, T.StringType):
            c = F.when(F.trim(c).isin(*sentinels), F.lit(None).cast(f.dataType)).otherwise(c)
        elif f.name in cols and isinstance(f.dataType, T.NumericType):
            for number in (Decimal(s.strip()) for s in sentinels if re.match(NUMBER_PATTERN, s.strip())):
                c = F.when(F.col(f.name) != F.lit(number), c)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(out)


def mask_card(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(CARD_MASK_PREFIX), F.right(c.cast("string"), F.lit(4))))


def hash_pii(c: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)


def mask(df: DataFrame, mask_cols: Sequence[str] = (), drop_cols: Sequence[str] = (),
         hash_cols: Sequence[str] = (), salt: str = "") -> DataFrame:
    """PCI/PII rules in one projection: mask to last 4, drop, or salted SHA-256."""
    upper_names = {n.upper() for n in mask_cols}
    drop_upper = {n.upper() for n in drop_cols}
    hash_upper = {n.upper() for n in hash_cols}
    out = []
    for f in df.schema.fields:
        up = f.name.upper()
        if up in drop_upper:
            continue
        if up in upper_names:
            out.append(mask_card(F.col(f.name)).alias(f.name))
        elif up in hash_upper:
            out.append(hash_pii(F.col(f.name), salt).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(out)


def snake_upper_name(name: str) -> str:
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_")
    return s.upper()


def snake_upper(df: DataFrame) -> DataFrame:
    """UPPER_SNAKE_CASE every column; refuse a rename that would collide."""
    names = [snake_upper_name(n) for n in df.columns]
    if len(set(names)) != len(names):
        dup = sorted({n for n in names if names.count(n) > 1})
        raise ValueError(f"column rename collides: {dup}")
    return df.toDF(*names)


def _plain_decimal(text: Column) -> Column:
    """Decimal text without the zeros at its end, but with one digit after the point."""
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")


def canonical_text(c: Column, dtype: T.DataType) -> Column:
    """Lossless text form used inside hashes and checksums; equal numbers have equal texts
    whether they are floats or decimals."""
    if isinstance(dtype, T.DecimalType):
        return _plain_decimal(c.cast("string")) if dtype.scale else F.concat(c.cast("string"), F.lit(".0"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        exact = c.try_cast(T.DecimalType(38, 18))
        return F.when(exact.cast(dtype) == c, _plain_decimal(exact.cast("string"))).otherwise(c.cast("string"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("true")).when(~c, F.lit("false"))
    return c.cast("string")


def canonical_row(df: DataFrame, cols: Sequence[str]) -> Column:
    """One text for the values of ``cols``, different for different values: each part is its
    length, a colon and its text, or a bare ``-`` for NULL."""
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = [canonical_text(F.col(c), types[c]) for c in cols]
    return F.concat(F.lit(""), *[F.when(x.isNull(), F.lit(NULL_MARK)).otherwise(F.concat(F.length(x).cast("string"), F.lit(":"), x))
                                 for x in texts])


def hash_key(df: DataFrame, cols: Sequence[str]) -> Column:
    """SHA-256 hex over the canonical text of ``cols``."""
    return F.sha2(canonical_row(df, cols), 256)


def to_text(c: Column, dtype: T.DataType, scale: int = 2, date_format: str = "yyyy-MM-dd") -> Column:
    """Numeric / date -> string with a fixed format (decimals through DECIMAL, so no
    exponent or binary noise; timestamps by an explicit pattern)."""
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType, T.IntegralType)):
        return c.cast(T.DecimalType(38, scale)).cast("string") if scale else c.cast("long").cast("string")
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, date_format)
    return c.cast("string")


def upc_standard(c: Column) -> tuple[Column, Column]:
    """(left-padded 12-digit UPC, is_standard flag)."""
    text = F.trim(c.cast("string"))
    return F.lpad(text, 12, "0"), text.rlike(r"^\d{12}$")

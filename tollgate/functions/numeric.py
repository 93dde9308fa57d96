"""Numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(value: Column) -> Column:
    """Limit to [0, 1]; NaN stays NaN and null stays null."""
    limited = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.when(value.isNull() | F.isnan(value), value).otherwise(limited)


def at_least(score: Column, threshold: Column | float) -> Column:
    """Whether a score reaches a threshold; NaN never does."""
    return ~F.isnan(score) & (score >= threshold)


# Characters that JavaScript trims.
JS_SPACE = " \t\n\v\f\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    chr(code) for code in range(0x2000, 0x200B)
)


def json_integer(text: Column, kind: Column) -> Column:
    """JSON value, given as text and type name, -> DECIMAL(38,0).

    Reads what a JavaScript ``BigInt(value)`` accepts: whole numbers, booleans, and text, where
    surrounding space is ignored, empty text is 0, a sign is allowed on decimals only, and ``0x``,
    ``0o``, ``0b`` prefixes are known. Anything else, and more than 38 digits, gives null.
    """
    whole = text.try_cast("decimal(38,0)")
    as_double = text.try_cast("double")
    trimmed = F.btrim(text, F.lit(JS_SPACE))
    is_text = kind == "STRING"
    return (
        F.when(((kind == "BIGINT") | is_text) & text.rlike("^[+-]?[0-9]+$"), whole)
        .when(kind.rlike("^(DECIMAL|DOUBLE)") & (as_double == F.floor(as_double)), whole)
        .when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0).cast("decimal(38,0)"))
        .when(~is_text, None)
        .when(trimmed == "", F.lit(0).cast("decimal(38,0)"))
        .when(trimmed.rlike("^[+-]?[0-9]+$"), trimmed.try_cast("decimal(38,0)"))
        .when(trimmed.rlike("^0([xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)$"), _prefixed(trimmed))
    )


def _prefixed(text: Column) -> Column:
    """``0x``, ``0o``, ``0b`` text in two parts of 60 bits each; null if it is longer."""
    letter = F.lower(text.substr(F.lit(2), F.lit(1)))
    base = F.when(letter == "x", 16).when(letter == "o", 8).otherwise(2)
    width = F.when(letter == "x", 15).when(letter == "o", 20).otherwise(60)
    digits = F.regexp_replace(text, "^0[a-zA-Z]0*(?=.)", "")
    low = F.call_function("conv", F.right(digits, width), base, F.lit(10))
    rest = digits.substr(F.lit(1), F.greatest(F.lit(0), F.length(digits) - width))
    high = F.when(F.length(digits) > width, F.call_function("conv", rest, base, F.lit(10))).otherwise("0")
    value = high.cast("decimal(19,0)") * F.lit(2**60).cast("decimal(19,0)") + low.cast("decimal(19,0)")
    return F.when(F.length(digits) <= 2 * width, value.cast("decimal(38,0)"))

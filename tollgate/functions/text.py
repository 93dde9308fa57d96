"""Text helpers: comma lists, and JSON text as a JavaScript producer writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_set(text: Column) -> Column:
    """Comma list -> array of distinct trimmed entries, blanks dropped."""
    trimmed = F.transform(F.split(text, ","), lambda part: F.regexp_replace(part, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda part: F.length(part) > 0))


def csv_entries(text: str) -> list[str]:
    """The same for a parameter."""
    return list(dict.fromkeys(part.strip() for part in text.split(",") if part.strip()))


def with_number_text(df: DataFrame, numbers: dict[str, str]) -> DataFrame:
    """Add texts of doubles as JavaScript writes them, ``{column: output}``; not finite -> ``null``.

    The runtime's own double text has the right digits when it has at most 15 of them; longer
    ones are replaced by a 16- or 17-digit text if that reads back as the same double. From 1e17
    on (no coordinate or score) the last of 17 digits may still differ by one. The steps are
    separate columns so that none is computed, or compiled, more than once.
    """
    def simple(name: str) -> Column:
        """Plain notation with at most 15 digits: nothing to repair."""
        size = F.abs(F.col(name))
        return (size >= 1e-3) & (size < 1e7) & (F.length(f"_raw_{name}") <= 16)

    def digits(name: str) -> Column:
        rare, value = ~simple(name), F.col(name)
        sixteen = F.when(rare, F.format_string("%.15e", name))
        seventeen = F.when(rare, F.format_string("%.16e", name))
        return (
            F.when(sixteen.try_cast("double") == value, sixteen)
            .when(seventeen.try_cast("double") == value, seventeen)
            .otherwise(F.col(f"_raw_{name}"))
        )

    def final(name: str) -> Column:
        value, text = F.col(name), F.col(f"_digits_{name}")
        size = F.abs(value)
        # The type of the detour decides how many decimals survive: 30 below one, 17 above.
        plain = F.when(size < 1, text.try_cast("decimal(38,30)").cast("string")).otherwise(
            text.try_cast("decimal(38,17)").cast("string")
        )
        scientific = F.regexp_replace(text, r"\.?0*[eE]\+?(-?)0*", "e$1")
        return (
            F.when(simple(name), F.when(
                F.endswith(F.col(f"_raw_{name}"), F.lit(".0")),
                F.col(f"_raw_{name}").substr(F.lit(1), F.length(f"_raw_{name}") - 2),
            ).otherwise(F.col(f"_raw_{name}")))
            .when(value == 0, "0")
            .when((size >= 1e-6) & (size < 1e21), F.regexp_replace(plain, r"\.?0+$", ""))
            .when(size < float("inf"), F.regexp_replace(scientific, "e(?=[0-9])", "e+"))
            .when(value.isNotNull(), "null")
        )

    return (
        df.withColumns({f"_raw_{name}": F.col(name).cast("string") for name in numbers})
        .withColumns({f"_digits_{name}": digits(name) for name in numbers})
        .withColumns({output: final(name) for name, output in numbers.items()})
        .drop(*[f"_raw_{name}" for name in numbers], *[f"_digits_{name}" for name in numbers])
    )


def json_text(members: Column, numbers: dict[str, str] | None = None) -> Column:
    """The JSON text of a struct; nulls are left out.

    ``numbers`` names members that are given as text, with the column of that text; their quotes are
    taken off. A quoted name with a colon cannot stand inside a string, where quotes are escaped.
    """
    text = F.to_json(members)
    for name, column in (numbers or {}).items():
        value = F.coalesce(F.col(column), F.lit(""))
        text = F.replace(text, F.concat(F.lit(f'"{name}":"'), value, F.lit('"')), F.concat(F.lit(f'"{name}":'), value))
    return text


def with_js_escapes(df: DataFrame, output: str, json: Column) -> DataFrame:
    """Add JSON text with its escapes as a JavaScript producer writes them."""
    text = F.col("_text")
    # Control characters: the writer uses upper-case hex, JavaScript lower-case. Escaped
    # backslashes are set aside meanwhile (as NUL, which cannot occur in the text), so that
    # text which only looks like an escape is left alone.
    lowered = F.replace(text, F.lit("\\\\"), F.lit("\0"))
    for code in (0x0B, 0x0E, 0x0F, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F):
        lowered = F.replace(lowered, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    lowered = F.replace(lowered, F.lit("\0"), F.lit("\\\\"))
    return (
        df.withColumn("_text", json)
        .withColumn(output, F.when(F.contains(text, F.lit("\\u00")), lowered).otherwise(text))
        .drop("_text")
    )


def with_json_text(df: DataFrame, output: str, members: Column, numbers: dict[str, str] | None = None) -> DataFrame:
    """Add the JSON text of a struct as a JavaScript producer writes it; see ``json_text``."""
    return with_js_escapes(df, output, json_text(members, numbers))

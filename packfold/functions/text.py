"""Text and number formatting as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit steps of ``human_readable``, largest first.
UNITS = ((1e15, "P"), (1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "K"), (1.0, ""), (1e-3, "m"), (1e-6, "u"))
# Replacements that keep a label on one TSV field.
TSV_REPLACEMENTS = (("\t", "    "), ("\n", "<br>"))
# Fixed value: where files of a hosted dataset are served.
HUB_URL = "https://huggingface.co/"

WHITESPACE = " \t\n\r\x0b\x0c"


def tsv_safe(text: Column) -> Column:
    for found, replacement in TSV_REPLACEMENTS:
        text = F.replace(text, F.lit(found), F.lit(replacement))
    return text


def two_decimals(number: Column) -> Column:
    """Two decimals with ties to even on the exact binary value."""
    return F.replace(F.format_number(number, 2), F.lit(","), F.lit(""))


def human_readable(number: Column) -> Column:
    """``12.34K`` style; a value must be above a unit to use it."""
    number = number.cast("double")
    out = F.format_string("%.2e", number)
    for base, unit in reversed(UNITS):
        scaled = F.concat(two_decimals(number / F.lit(base)), F.lit(unit))
        out = F.when(F.abs(number) > F.lit(base), scaled).otherwise(out)
    return F.when(F.isnan(number), F.lit("nan")).otherwise(out)


def file_url(path: Column, prefix: str) -> Column:
    """Download address of a hosted file; paths outside ``prefix`` stay as they are."""
    start = f"{prefix}/"
    rest = F.substr(path, F.lit(len(start) + 1))
    return F.when(F.startswith(path, F.lit(start)), F.concat(F.lit(f"{HUB_URL}{prefix}/resolve/main/"), rest)).otherwise(path)


# A place for a number: {i}, or {i:05d} with leading zeros up to a width, or {i:5d} with spaces.
NUMBER_PLACE = re.compile(r"\{i(?::(0?)(\d*)d?)?\}")


def numbered_path(pattern: str, number: Column) -> Column:
    """``pattern`` with the number in every place for one; a longer number is not cut."""
    parts, at = [], 0
    for place in NUMBER_PLACE.finditer(pattern):
        digits, width = number.cast("string"), int(place[2] or 0)
        padded = F.lpad(digits, width, "0" if place[1] else " ") if width else digits
        parts += [F.lit(pattern[at : place.start()]), F.when(F.length(digits) < width, padded).otherwise(digits)]
        at = place.end()
    return F.concat(*parts, F.lit(pattern[at:]))


def json_line(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def json_value(value: Column) -> Column:
    """Any value as JSON, a text as a quoted one."""
    listed = json_line(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def stripped(text: Column | str) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))

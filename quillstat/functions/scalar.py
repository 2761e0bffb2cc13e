"""Column functions: half-even rounding, duration and clock parsing, safe ratios, plane geometry, JSON text."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Period lengths in minutes.
QUARTER_MIN, OVERTIME_MIN, QUARTERS = 12.0, 5.0, 4


def half_even(x: Column, digits: int) -> Column:
    """Rounds to `digits` decimals, ties to the even digit of the scaled value."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def number(x: Column) -> Column:
    """A tolerant parse: whatever is no number is null."""
    return finite(x.try_cast("double"))


def shown_int(x: Column) -> Column:
    return F.rint(number(x)).cast("long")


def shown_1dp(x: Column) -> Column:
    return half_even(number(x), 1)


def shown_pct(x: Column) -> Column:
    return half_even(number(x) * 100, 1)


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where whole is zero."""
    return F.try_divide(part * 100.0, whole)


def minutes(value: Column) -> Column:
    """`m:ss`, ISO `PTmMs.sS` or a plain number of minutes, as a double; anything else is null."""
    text = F.trim(value.cast("string"))
    colon, iso = r"^(\d+):(\d+(?:\.\d+)?)$", r"^PT(\d+)M(\d+(?:\.\d+)?)S$"

    def parsed(pattern: str) -> Column:
        m, s = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
        return m.try_cast("double") + s.try_cast("double") / 60.0

    return F.when(text.rlike(colon), parsed(colon)).when(text.rlike(iso), parsed(iso)).otherwise(number(text))


def clock_seconds(clock: Column) -> Column:
    """Seconds left on a `PTmMs.sS` clock; malformed clocks are null."""
    pattern = r"^PT(\d+)M(\d+(?:\.\d+)?)S$"
    m, s = F.regexp_extract(clock, pattern, 1), F.regexp_extract(clock, pattern, 2)
    return F.when(clock.rlike(pattern), m.try_cast("double") * 60.0 + s.try_cast("double"))


def elapsed_minutes(period: Column, clock: Column) -> Column:
    """Game minutes gone at a clock reading: four quarters, then overtimes."""
    before = F.least(period - 1, F.lit(QUARTERS)) * QUARTER_MIN + F.greatest(period - 1 - QUARTERS, F.lit(0)) * OVERTIME_MIN
    length = F.when(period <= QUARTERS, F.lit(QUARTER_MIN)).otherwise(F.lit(OVERTIME_MIN))
    return before + length - clock_seconds(clock) / 60.0


def feet(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Where a person's box touches the floor: the middle of its lower edge."""
    return (x1 + x2) / 2, y2


def ball_coloured(hue: Column, saturation: Column, value: Column) -> Column:
    """Whether median colours of a patch are those of a ball."""
    return hue.between(3, 17) & (saturation >= 70) & value.between(90, 200)


def project(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """The point (x, y) under the 3x3 row-major map h."""
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def inverse(h: list[Column]) -> list[Column]:
    """The adjugate of a 3x3 row-major map: its inverse up to a factor, which `project` cancels."""
    a, b, c, d, e, f, g, i, j = h
    return [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]


def json_number(x: Column) -> Column:
    """A double as JSON text: its shortest digits, with an exponent only below 1e-6 and from 1e21 on (the cast has one from 1e7)."""
    size, digits = F.abs(x), [F.format_string(f"%.{n}e", x) for n in (14, 15, 16)]
    # Java's own text can have a digit or two more than tell the number from all others.
    text = F.coalesce(*[F.when(t.try_cast("double") == x, t) for t in digits], x.cast("string"))

    def plain(scale: int) -> Column:
        return F.regexp_replace(text.try_cast(f"decimal(38,{scale})").cast("string"), r"(\.\d+?)0*$", "$1")

    short = F.regexp_replace(text, r"\.?0*[eE]\+?(-?)0*", "e$1")
    return F.when(size == 0, x.cast("string")).when(size.between(1e-6, 1e7), plain(22)).when((size > 1e7) & (size < 1e21), plain(10)).otherwise(short)


def json_text(x: Column, kind: T.DataType) -> Column:
    """A value of type `kind` as JSON: like `to_json`, but nulls stay and doubles are written by `json_number`."""
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), json_text(x.getField(f.name), f.dataType)) for f in kind]
        text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(x), lambda e: F.concat(json_text(e["key"].cast("string"), T.StringType()), F.lit(":"), json_text(e["value"], kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: json_text(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.DoubleType):
        text = json_number(x)
    else:
        text = F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    return F.when(x.isNull(), "null").otherwise(text)

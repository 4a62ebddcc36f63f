"""Values as short Spanish texts, and keys made of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(value: Column, digits: int) -> Column:
    return F.translate(F.format_string(f"%.{digits}f", value.cast("double")), ".", ",")


def _whole(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


def distance(metres: Column) -> Column:
    km = metres / 1000
    return F.when(metres < 1000, F.concat(_whole(metres), F.lit(" m"))).otherwise(F.concat(F.when(km < 10, _number(km, 1)).otherwise(_number(km, 0)), F.lit(" km")))


def duration(seconds: Column) -> Column:
    m = _whole(seconds / 60)
    hours, rest = F.floor(m / 60), m % 60
    long_ = F.when(rest == 0, F.concat(hours, F.lit(" h"))).otherwise(F.concat(hours, F.lit(" h "), F.lpad(rest.cast("string"), 2, "0"), F.lit(" min")))
    return F.when(m < 60, F.concat(F.greatest(m, F.lit(1)), F.lit(" min"))).otherwise(long_)


def size(bytes_: Column) -> Column:
    mb = bytes_ / 1e6
    return (F.when(bytes_ < 1000, F.concat(bytes_, F.lit(" B"))).when(bytes_ < 1_000_000, F.concat(_whole(bytes_ / 1000), F.lit(" KB")))
            .when(bytes_ < 1_000_000_000, F.concat(F.when(mb < 10, _number(mb, 1)).otherwise(_number(mb, 0)), F.lit(" MB"))).otherwise(F.concat(_number(bytes_ / 1e9, 1), F.lit(" GB"))))


def percent(share: Column) -> Column:
    return F.concat(F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 100), F.lit(" %"))


def elapsed(seconds: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(seconds / 3600)  # may have more digits than two
    return F.concat_ws(":", F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), two(F.floor(seconds / 60) % 60), two(F.floor(seconds % 60)))


def since(moment: Column, now: Column) -> Column:
    """How long ago, and the date for what is a day old or more."""
    s = F.unix_timestamp(now) - F.unix_timestamp(moment)
    day = F.when(F.to_date(moment) == F.to_date(now), F.date_format(moment, "HH:mm")).otherwise(F.date_format(moment, "dd/MM/yyyy HH:mm"))
    said = lambda n, unit: F.concat(F.lit("hace "), n, F.lit(unit))
    return F.when(s < 60, said(F.greatest(s, F.lit(0)), " s")).when(s < 3600, said(F.floor(s / 60), " min")).when(s < 86400, said(F.floor(s / 3600), " h")).otherwise(day)


def hour_bucket(moment: Column, zone: str) -> Column:
    """Weekday and hour in a time zone."""
    return F.date_format(F.from_utc_timestamp(moment, zone), "E-HH")


def cache_key(*values: Column) -> Column:
    """A short key of values, whatever their types."""
    return F.sha1(F.to_json(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])))


# fixed value: two streets and what stands between them
CROSSING = "(?i)^(.+?)\\s+(?:y|e|&|esq\\.?|esquina|con|interseccion|intersección)\\s+(.+)$"


def crossing(text: Column) -> Column:
    """The two streets of a text such as "Amazonas y Colón"; null where it names no crossing."""
    return F.when(text.rlike(CROSSING), F.struct(F.regexp_extract(text, CROSSING, 1).alias("first"), F.regexp_extract(text, CROSSING, 2).alias("second")))


def address(context: Column) -> Column:
    """city and state of a context line: what follows the last middle dot, in parts between commas."""
    parts = F.split(F.element_at(F.split(context, " · "), -1), ", ")
    three = F.size(parts) >= 3
    return F.struct(F.when(three, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))).alias("city"), F.when(three, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("state"))


def json_id(payload: Column, field: str) -> Column:
    """A UUID in a JSON field; null where the field holds none."""
    v = F.get_json_object(payload, f"$.{field}")
    return F.when(v.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lower(v))

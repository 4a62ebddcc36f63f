"""SQL expressions that the checks share, written apart from the column expressions they are held against."""

from __future__ import annotations

DEG = "111195.08e0"


def great_circle(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"2 * 6371008.8e0 * asin(sqrt(case when {h} > 1 then 1e0 else {h} end))"


def to_segment(lon: str, lat: str, x1: str, y1: str, x2: str, y2: str) -> str:
    """Metres from a point to a segment in the plane at the point's latitude."""
    kx = f"(cos(radians({lat})) * {DEG})"
    px, py = f"(({lon} - {x1}) * {kx})", f"(({lat} - {y1}) * {DEG})"
    dx, dy = f"(({x2} - {x1}) * {kx})", f"(({y2} - {y1}) * {DEG})"
    t = f"coalesce(least(greatest(({px} * {dx} + {py} * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0), 0e0), 1e0), 0e0)"
    return f"sqrt(pow({px} - {t} * {dx}, 2) + pow({py} - {t} * {dy}, 2))"


def folded(text: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({text})), '[^0-9a-z]+', ' ', 'g'))"


CELL = "cast(round(cast(lon as decimal(18,9)), 3) as double) as cell_lon, cast(round(cast(lat as decimal(18,9)), 3) as double) as cell_lat"
KMH = "round(cast(sum(cast(speed as decimal(18,6))) * cast(3.6 as decimal(3,1)) as double) / count(*), 1)"

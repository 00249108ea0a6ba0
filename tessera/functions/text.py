"""Labels, redaction and small scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Redaction rules, in order; case is ignored.
REDACT = [
    (r"(password|passwd|pwd)=[^\s&]+", "$1=***REDACTED***"),
    (r"(token|api_key|apikey)=[^\s&]+", "$1=***REDACTED***"),
    (r"(secret|auth|authorization)=[^\s&]+", "$1=***REDACTED***"),
    (r"Bearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer ***REDACTED***"),
    (r"\b([a-zA-Z])[a-zA-Z0-9._%+-]*@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b", "$1***@$2"),
    (r"([C-Z]:\\Users\\)([^\\]+)(\\)", "$1***$3"),
    (r"(/home/)([^/]+)", "$1***"),
    (r"(session|temp|tmp)_[a-zA-Z0-9]+", "$1_***"),
]


def redacted(text: Column) -> Column:
    for pattern, put in REDACT:
        text = F.regexp_replace(text, "(?i)" + pattern, put)
    return text


def fixed(v: Column, digits: int) -> Column:
    """A number with so many digits, rounded half to even by its exact binary value as C and Python do; ``format_string`` rounds
    its shortest decimals half up."""
    return F.call_function("format_number", v, F.lit("0." + "0" * digits))


def canopy_text(radius_m: Column, show: str = "diameter", prefix: str = "") -> Column:
    """Radius, diameter or both in metres with two digits; ``prefix`` is ``Avg `` for means."""
    r, d = (F.concat(F.lit(f"{k}: "), fixed(v, 2), F.lit("m")) for k, v in (("R", radius_m), ("D", radius_m * 2)))
    return F.concat(F.lit(prefix), {"radius": r, "both": F.concat(r, F.lit(" | "), d)}.get(show, d))


def place_text(x: Column, y: Column, lonlat: Column) -> Column:
    """Six digits of longitude and latitude, two of other coordinates."""
    pair = lambda a, b, n: F.concat(F.lit(f"{a}: "), fixed(x, n), F.lit(f" | {b}: "), fixed(y, n))
    text = F.when(lonlat, pair("Lon", "Lat", 6)).otherwise(pair("X", "Y", 2))
    return F.when(x.isNull() | y.isNull(), "Lon: - | Lat: -").otherwise(text)


def eta_text(elapsed: Column, percent: Column) -> Column:
    left = F.greatest(F.lit(0), (elapsed / percent * 100 - elapsed).cast("int"))
    return F.concat(F.lit("Elapsed: "), clock(elapsed.cast("int")), F.lit(" | ETA: "), F.when(percent > 0, clock(left)).otherwise("--:--"))


def area_label(m2: Column) -> Column:
    """Over a hectare in hectares with whole square metres, else in square metres."""
    large = F.concat(fixed(m2 / 10_000, 2), F.lit(" ha ("), F.format_number(m2, 0), F.lit(" m²)"))
    return F.concat(F.lit("Area\n"), F.when(m2 > 10_000, large).otherwise(F.concat(F.format_number(m2, 2), F.lit(" m²"))))


def crs_label(epsg: Column, name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("EPSG:"), epsg.cast("string")), F.substring(name, 1, 20))


def short_name(name: Column) -> Column:
    return F.when(F.char_length(name) > 18, F.concat(F.substring(name, 1, 15), F.lit("..."))).otherwise(name)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1)


def clock(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, v))


def argmax(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)) - 1


def layer_kind(path: Column) -> Column:
    return F.when(F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1)).isin(".shp", ".geojson", ".json"), "vector").otherwise("raster")

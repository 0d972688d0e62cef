"""The formulas of spatial-keyword search. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whatever lies between tokens.
TOKEN_GAP = r"[^\p{L}\p{N}]+"

#: Neighbourhood rules by their codes in configurations.
NEAREST, RANGE, INFLUENCE = "nn", "range", "influence"
NEIGHBOURHOODS = {0: NEAREST, 1: RANGE, 2: INFLUENCE}


def tokens(text: Column) -> Column:
    """The lower-case runs of letters and digits of a text or query, in order. Null for null."""
    return F.filter(F.split(F.lower(text), TOKEN_GAP), lambda t: t != "")


def has_tokens(text: Column) -> Column:
    return F.coalesce(F.size(tokens(text)) > 0, F.lit(False))


def term_weight(frequency: Column) -> Column:
    """Weight of a term that occurs ``frequency`` times in a text: 1 + ln f."""
    return 1 + F.log(frequency.cast("double"))


def norm(weight: Column) -> Column:
    """Aggregate: length of the vector of weights."""
    return F.sqrt(F.sum(weight * weight))


def query_weight(n_features: Column, document_frequency: Column) -> Column:
    """Weight of a query term: ln(1 + N / df)."""
    return F.log(1 + n_features.cast("double") / document_frequency)


def impact(weight: Column, length: Column) -> Column:
    """A term's weight in its text, normalised by the text's vector length."""
    return weight / length


def textual_partial(term_impact: Column, weight: Column, length: Column) -> Column:
    """What one query term adds to a feature's textual relevance."""
    return term_impact * (weight / length)


def spatial_partial(distance: Column, most: float, alpha: float, n_terms: int = 1) -> Column:
    """What nearness adds for each of ``n_terms`` query terms."""
    return F.lit(float(alpha)) * (1 - distance / F.lit(float(most))) / F.lit(float(n_terms))


def distance(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance in coordinate units."""
    dx, dy = lat - lat2, lon - lon2
    return F.sqrt(dx * dx + dy * dy)


def rounded(x: Column, places: int) -> Column:
    """A double of 0 or more, below 2**63 once scaled, rounded half up by scaling, as DuckDB does.

    F.round takes each value through a decimal's text, which costs twice what joining its row does.
    """
    scale = F.lit(10.0**places)
    return F.floor(x * scale + 0.5) / scale


def axis_gap(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """How far two closed intervals are apart, 0 if they meet."""
    return F.greatest(lo2 - hi, lo - hi2, F.lit(0.0))


def axis_span(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """The largest distance between points of two intervals."""
    return F.greatest(hi2 - lo, hi - lo2)


def rect_min_distance(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """The smallest distance between points of two rectangles (min_lat, min_lon, max_lat, max_lon)."""
    dx, dy = axis_gap(a[0], a[2], b[0], b[2]), axis_gap(a[1], a[3], b[1], b[3])
    return F.sqrt(dx * dx + dy * dy)


def rect_max_distance(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    dx, dy = axis_span(a[0], a[2], b[0], b[2]), axis_span(a[1], a[3], b[1], b[3])
    return F.sqrt(dx * dx + dy * dy)


def in_rect(lat: Column, lon: Column, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    """Whether a point lies in a closed rectangle."""
    return lat.between(min_lat, max_lat) & lon.between(min_lon, max_lon)


def decay(dist: Column, radius: float) -> Column:
    """How influence fades: it halves every ``radius``."""
    return F.pow(F.lit(2.0), -dist / F.lit(float(radius)))


def space_diagonal(space_max: float = 10000.0) -> float:
    return math.sqrt(2) * space_max


def neighbourhood_name(code: Column) -> Column:
    """The rule of a code, null for other codes."""
    out = F.lit(None).cast("string")
    for k, name in NEIGHBOURHOODS.items():
        out = F.when(code == k, F.lit(name)).otherwise(out)
    return out


def neighbourhood(rule: str | int) -> str:
    """The rule of a code or name; ValueError for others."""
    name = NEIGHBOURHOODS.get(rule, rule) if isinstance(rule, int) else NEIGHBOURHOODS.get(int(rule), rule) if str(rule).strip().isdigit() else str(rule)
    if name not in NEIGHBOURHOODS.values():
        raise ValueError(f"unknown neighbourhood: {rule!r}")
    return name


def storage_bucket(term_id: Column) -> Column:
    """Folder of a term's own index: two levels of a thousand."""
    return F.concat_ws("/", F.floor(term_id / 1_000_000).cast("string"), F.floor(term_id / 1000).cast("string"))


def df_or_absent(document_frequency: Column) -> Column:
    """The document frequency, -1 where the term is unknown."""
    return F.coalesce(document_frequency, F.lit(-1))


def nearly_equal(a: dict[str, Column], b: dict[str, Column], tolerance: float = 1e-9) -> Column:
    """Equality of scored rows: same id and place, and a score within ``tolerance``."""
    return (a["id"] == b["id"]) & (a["lat"] == b["lat"]) & (a["lon"] == b["lon"]) & (F.abs(a["score"] - b["score"]) < tolerance)


def rendered(**columns: Column) -> Column:
    """A row as text: name=value, separated by blanks."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit("null"))) for k, c in columns.items()])

"""Colour maps and colours of values."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours of commodities.
COMMODITY = {
    "Au": "#FFD700", "Ag": "#C0C0C0", "Cu": "#B87333", "Fe": "#8B4513", "Ni": "#4CAF50", "Zn": "#78909C",
    "Pb": "#607D8B", "Mo": "#9C27B0", "Co": "#2196F3", "Li": "#FF5722", "Mn": "#795548", "Cr": "#009688",
    "V": "#673AB7", "W": "#FF9800", "Sn": "#9E9E9E", "Ti": "#00BCD4", "Al": "#FFEB3B", "U": "#8BC34A",
}
# Colours of lithologies.
LITHOLOGY = {
    "shale": "#607D8B", "mudstone": "#78909C", "siltstone": "#90A4AE", "sandstone": "#F5CBA7",
    "limestone": "#B0BEC5", "dolomite": "#CFD8DC", "conglomerate": "#D7CCC8", "coal": "#212121",
    "BIF": "#8B4513", "ironstone": "#A0522D", "granite": "#EF9A9A", "granodiorite": "#F48FB1",
    "diorite": "#CE93D8", "gabbro": "#546E7A", "peridotite": "#33691E", "pegmatite": "#FFF9C4",
    "basalt": "#37474F", "andesite": "#78909C", "rhyolite": "#FFCCBC", "dacite": "#FFAB91",
    "tuff": "#D7CCC8", "breccia": "#BCAAA4", "schist": "#80CBC4", "gneiss": "#4DB6AC",
    "quartzite": "#E0F7FA", "marble": "#F5F5F5", "slate": "#455A64", "phyllite": "#80DEEA",
    "quartz": "#ECEFF1", "calcite": "#F9FBE7", "vein": "#FFFFFF", "unknown": "#9E9E9E",
}
BUILT_IN = {"commodity": COMMODITY, "lithology": LITHOLOGY}


def resolve_colour_map(wanted: str | Mapping[str, str] | None) -> Mapping[str, str]:
    """A map by name, a map as it is, or none."""
    match wanted:
        case None:
            return {}
        case str():
            if wanted.strip().lower() not in BUILT_IN:
                raise ValueError(f"no colour map {wanted!r}; there are {sorted(BUILT_IN)}")
            return BUILT_IN[wanted.strip().lower()]
        case Mapping():
            return wanted
    raise TypeError(f"a colour map is a name or a mapping, not {type(wanted).__name__}")


def _entries(colours: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in colours.items() for x in kv]) if colours else F.expr("map()").cast("map<string,string>")


def colour(value: Column, colours: Mapping[str, str], fallback: str) -> Column:
    """Colour of a value: exact, else whatever the case, else the fallback."""
    lower = {k.lower(): v for k, v in reversed(colours.items())}
    text = value.cast("string")
    return F.coalesce(F.try_element_at(_entries(colours), text), F.try_element_at(_entries(lower), F.lower(text)), F.lit(fallback))


def commodity_colour(column: str | None) -> str | None:
    """Colour of the commodity that a column's name holds as one of its parts."""
    lower = {k.lower(): v for k, v in COMMODITY.items()}
    parts = re.split(r"[_\-/\s]+", column or "")
    return next((COMMODITY.get(p) or lower[p.lower()] for p in parts if p.lower() in lower), None)


def seeded_unit(text: Column) -> Column:
    """32-bit FNV-1a hash of a text's UTF-16 units, scaled to [0, 1]."""
    units = F.filter(F.split(F.hex(F.encode(text, "UTF-16BE")), "(?<=\\G.{4})"), lambda u: u != "")

    def step(h: Column, u: Column) -> Column:
        return (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))

    return F.aggregate(units, F.lit(2166136261).cast("long"), step) / F.lit(4294967295.0)


def hsl(hue: Column, saturation: float, lightness: float) -> Column:
    """#rrggbb of a colour with hue in [0, 1] (the usual piecewise-linear conversion)."""
    top = lightness * (1 + saturation) if lightness <= 0.5 else lightness + saturation - lightness * saturation
    low = 2 * lightness - top

    def part(shift: float) -> Column:
        h = F.pmod(hue + shift, F.lit(1.0))
        value = F.when(h < 1 / 6, low + (top - low) * 6 * h).when(h < 1 / 2, F.lit(top)).when(h < 2 / 3,
            low + (top - low) * 6 * (2 / 3 - h)).otherwise(F.lit(low))
        return F.lpad(F.lower(F.hex(F.floor(value * 255 + 0.5).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), part(1 / 3), part(0.0), part(-1 / 3))


GREY = "#9e9e9e"


def category_hash_colour(value: Column) -> Column:
    """A category's own colour, whatever its case; grey where it is blank."""
    text = F.trim(value.cast("string"))
    return F.when(F.coalesce(text, F.lit("")) == "", GREY).otherwise(hsl(seeded_unit(F.lower(text)), 0.70, 0.50))


def segment_hash_hue(hole: Column, index: Column) -> Column:
    """Hue in [0, 1) of a segment without a value: 14 bands along the hole, shifted by the hole."""
    seed = F.concat(F.coalesce(hole.cast("string"), F.lit("")), F.lit(":"), index.cast("string"))
    return F.pmod(seeded_unit(seed) * 0.15 + (index % 14) / 14.0 * 0.85, F.lit(1.0))


def golden_hue(index: Column) -> Column:
    """Hue in [0, 1) of the i-th hole, a golden angle apart."""
    return F.pmod(index * 137.5, F.lit(360.0)) / 360.0


def value_hue(value: Column, low: float, high: float) -> Column:
    """Hue from 240 (low) to 0 (high)."""
    part = F.lit(0.5) if high <= low else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))
    return (F.lit(1.0) - part) * 240.0


def category_hue(index: Column, n: int) -> Column:
    return index / F.lit(float(max(1, n))) * 360.0

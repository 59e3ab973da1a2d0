"""Values a chart or a selection box needs beside the measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.functions.measures import clip, or_zero

# Marker colours run from blue to red, grey where nothing is known.
UNKNOWN_RGBA = (160, 160, 160, 140)
KNOWN_ALPHA = 170
RED = (20, 235)
GREEN = (60, 40)
BLUE = (210, 190)

# Marker radius.
RADIUS_PER_ROOT_DAY = 20
RADIUS_RANGE = (2000.0, 12000.0)


def utilization_rgba(utilization: Column) -> Column:
    """Array of red, green, blue and alpha for a utilization between 0 and 1."""
    level = clip(utilization.cast("double"), 0.0, 1.0)
    known = F.array(
        (RED[0] + RED[1] * level).cast("int"),
        (GREEN[0] + GREEN[1] * (1 - level)).cast("int"),
        (BLUE[0] - BLUE[1] * level).cast("int"),
        F.lit(KNOWN_ALPHA),
    )
    unknown = F.array(*(F.lit(part) for part in UNKNOWN_RGBA))
    return F.when(utilization.isNull(), unknown).otherwise(known)


def marker_radius(resident_days: Column) -> Column:
    """Whole-number radius that grows with the root of the resident days."""
    days = F.greatest(or_zero(resident_days).cast("double"), F.lit(0.0))
    return clip(RADIUS_PER_ROOT_DAY * F.sqrt(days), *RADIUS_RANGE).cast("int")


def facility_label(name: Column, ccn: Column, state: Column) -> Column:
    """Text shown in the facility box, e.g. ``Oak Home (012345) – TX``."""
    shown = [F.coalesce(part.cast("string"), F.lit("None")) for part in (name, ccn, state)]
    return F.format_string("%s (%s) – %s", *shown)

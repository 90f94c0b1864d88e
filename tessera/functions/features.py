"""Feature columns by the target they are for."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Columns made from appraisals and parcels, which tell a property value's target.
LEAKING = {"property_value": ("log_appvalue", "build_to_land_ratio", "bldg_footprint_m2", "bldg_vertex_count", "log_acres", "LUCODE", "PROPTYPE", "osm_building_type")}
#: What the encoder of buildings makes of them.
ENCODED = {"log_appvalue": ("log_value",), "build_to_land_ratio": ("build_land_ratio", "ratio"), "bldg_footprint_m2": ("log_area",), "bldg_vertex_count": ("vertices",), "log_acres": ("acres", "log_acres"), "LUCODE": ("lu_1", "lu_2", "lu_3", "lu_other"), "osm_building_type": ("residential",)}


def for_target(features: DataFrame, target: str) -> DataFrame:
    """The features without the columns, raw or encoded, that would leak the target; other targets keep all."""
    gone = {n.lower() for raw in LEAKING.get(target, ()) for n in (raw, *ENCODED.get(raw, ()))}
    return features.select(*(c for c in features.columns if c.lower() not in gone))

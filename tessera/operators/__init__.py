"""Operators as named SQL plans, by family."""

from . import access, aggregates, disaggregation, graphs, joins, projections, scans, spatial, statistics, validators, windows

PLANS: dict[str, str] = {}
for _family in (scans, projections, joins, access, aggregates, windows, disaggregation, graphs, spatial, statistics, validators):
    PLANS |= _family.PLANS

"""Areal disaggregation and spatial validation on Spark."""

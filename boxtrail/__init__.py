"""Incident and vehicle analytics on tables of per-frame detections, as Spark DataFrames."""

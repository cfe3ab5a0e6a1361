"""Arborlake: ground-based forest scans to stem inventories, as Spark DataFrames."""

"""Spark-native occupancy analytics: grids, joins, scoring, gates, ranking."""

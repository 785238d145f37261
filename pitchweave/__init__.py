"""Spark-native analytics over multi-camera trajectories."""

"""Thermal-event analytics on Spark."""

"""Tidewright: PySpark jobs for change feeds, lineage, maintenance and monitoring data."""

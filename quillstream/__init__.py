"""Quillstream: Spark-first analytics over assistant telemetry, attribution and text."""

"""Variant-table analytics as DataFrame-to-DataFrame operators on PySpark."""

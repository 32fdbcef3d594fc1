"""Veloria: person-event analytics on PySpark."""

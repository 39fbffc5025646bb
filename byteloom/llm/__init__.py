"""Operators of a training-data pipeline. Nothing else in byteloom imports this subpackage."""

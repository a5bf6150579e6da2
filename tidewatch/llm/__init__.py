"""Operators for training-data pipelines. Nothing else in tidewatch imports this subpackage."""

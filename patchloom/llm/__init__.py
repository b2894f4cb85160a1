"""Operators of a training-data pipeline; ``queries`` lists what the driver runs."""

"""Bars from raw records, dimensions, sinks and the shared folder."""

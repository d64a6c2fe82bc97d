"""Operators over lines: search, sets, ranges, formats and alerts."""

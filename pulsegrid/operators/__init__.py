"""Operators over an ordered series: order, windows, patterns, occurrences, fits."""

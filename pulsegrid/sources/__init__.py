"""Readers and writers: raw readings, discretised series, pattern tables, event tables."""

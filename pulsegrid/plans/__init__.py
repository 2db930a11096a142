"""Whole queries over the event tables, with the SQL that says the same."""

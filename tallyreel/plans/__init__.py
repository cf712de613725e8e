"""Finished reports, chart tables, context tables and the view-class forecast."""

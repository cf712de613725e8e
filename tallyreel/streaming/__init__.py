"""Continuous loading of landed report files."""

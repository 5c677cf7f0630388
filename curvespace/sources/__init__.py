"""Readers and writers: trajectory files, point tables, run directories."""

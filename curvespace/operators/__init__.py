"""Operators over points, key ranges and placements."""

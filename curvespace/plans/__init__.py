"""Compositions: analytics over placements and runs, and whole experiments."""

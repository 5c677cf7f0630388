"""Spatio-temporal trajectory analytics on Spark: curve keys, covers, ring placement, window queries."""

"""Column functions: quantization, curve keys, hashes, time and distance."""

from curvespace.functions.curves import block_id, encode, hilbert2, hilbert_xy, morton2, morton3
from curvespace.functions.geo import haversine_m, speed_kmh
from curvespace.functions.hashing import fnv1a64, trajectory_id, unsigned_text
from curvespace.functions.quantize import quantize
from curvespace.functions.timeparse import iso_utc, local_to_utc, parse_seconds, rfc3339

__all__ = ["block_id", "encode", "fnv1a64", "haversine_m", "hilbert2", "hilbert_xy", "iso_utc", "local_to_utc", "morton2", "morton3", "parse_seconds", "quantize", "rfc3339", "speed_kmh", "trajectory_id", "unsigned_text"]

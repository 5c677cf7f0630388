"""Training-data operators: packing, search, sharding, de-duplication, formatting, scoring, archives."""

"""Training-data operators: language id, preference formatting, quality rules,
packing, n-gram joins, source mixing, fingerprints, token files and two exact
substring deduplicators. Nothing outside this package imports it."""

"""Part of the grainlake engine."""

"""Part of grainmill: sources."""

"""Part of subsetlab."""

"""siltstone.functions."""

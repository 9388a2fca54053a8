"""siltstone.sources."""

"""alloy.sources."""

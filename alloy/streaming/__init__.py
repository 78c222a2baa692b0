"""alloy.streaming."""

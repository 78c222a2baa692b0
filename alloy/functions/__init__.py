"""alloy.functions."""

"""alloy.operators."""

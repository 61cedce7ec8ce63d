"""Column functions with the engine's own null, overflow and text rules."""

"""Stepwise reading of results. Inputs are fixed snapshots; there are no unbounded sources."""

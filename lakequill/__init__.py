"""Lakequill: a read-only analytical SQL engine expressed in Spark plans."""

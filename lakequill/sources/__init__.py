"""Where rows come from: parquet folders and descriptions of their tables."""

"""Named plans with their SQL twins, and the front end for SQL text."""

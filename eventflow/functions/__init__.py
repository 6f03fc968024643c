"""Column-level building blocks: paths, conditions, patterns, JSON, templates."""

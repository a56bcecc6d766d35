"""Column-level building blocks: name catalogue, null / division policy."""

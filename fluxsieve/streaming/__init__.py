"""Row-wise curation applied to a streaming DataFrame."""

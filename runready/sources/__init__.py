"""runready.sources."""

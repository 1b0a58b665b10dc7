"""runready.streaming."""

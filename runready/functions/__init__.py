"""runready.functions."""

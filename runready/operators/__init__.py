"""runready.operators."""

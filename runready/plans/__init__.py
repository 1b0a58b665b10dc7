"""runready.plans."""

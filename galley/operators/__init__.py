"""operators of the review engine."""

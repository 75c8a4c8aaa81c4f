"""streaming of the review engine."""

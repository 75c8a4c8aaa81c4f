"""sources of the review engine."""

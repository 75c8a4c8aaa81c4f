"""functions of the review engine."""

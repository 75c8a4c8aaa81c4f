"""plans of the review engine."""

"""Driver-side text and chart helpers for small results."""

"""Health as a stream of samples, and rates."""

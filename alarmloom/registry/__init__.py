"""Driver-facing queries and the equivalent SQL."""

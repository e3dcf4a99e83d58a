"""Vector operators as DataFrame programs."""

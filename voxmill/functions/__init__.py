"""..."""

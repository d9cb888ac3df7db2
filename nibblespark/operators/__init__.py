"""Array operators as DataFrame transformations."""

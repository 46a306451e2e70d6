"""operators of helixlake."""

"""sources of helixlake."""

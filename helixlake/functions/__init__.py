"""functions of helixlake."""

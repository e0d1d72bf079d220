"""Complete entity-resolution workflows."""

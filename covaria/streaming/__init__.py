"""State dynamics over streams."""

"""Column functions on ids, vectors and matrices held in arrays."""

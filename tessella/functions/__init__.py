"""Column functions: vectors, poses, strings and geometry."""

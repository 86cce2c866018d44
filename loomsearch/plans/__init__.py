"""Query parsing and the plan of a whole search."""

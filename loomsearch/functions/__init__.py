"""Column expressions for text, urls and ranking signals."""

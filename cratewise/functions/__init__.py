"""Column expressions: text, JSON variants, categories, presentation."""

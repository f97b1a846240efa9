"""Column expressions: text, prompts, responses."""

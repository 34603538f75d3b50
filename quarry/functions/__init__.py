"""Column functions: paths, text, relevance, tokens, secrets, stems."""

"""Column functions: tokens, relevance, spans, similarity and times."""

"""Query operators: corpus search, pair matching and semantic recall."""

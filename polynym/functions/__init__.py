"""Column functions: text, scripts, transliteration, similarity."""

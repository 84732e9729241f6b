"""Column functions: lexing, names, renaming, draws, similarity."""

"""Column functions and the word lists they use."""

"""Column functions: text cleaning, tokens, labels and confidence levels."""

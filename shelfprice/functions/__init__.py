"""Column functions: text, quantities, prices, relevance, labels and URLs."""

"""Training-data operators over document, vector and page tables."""

"""Training-data operators: ten corpus operators and their queries."""

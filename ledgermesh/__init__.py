"""Entity-graph and market-data analytics as DataFrame-to-DataFrame functions."""

"""Training-data operators: one module for each, plus the registry of their queries."""

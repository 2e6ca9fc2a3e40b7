"""Training-data operators: each module is one operator on a documents-like DataFrame."""

"""Feature, exploration and model plans built from the operators."""

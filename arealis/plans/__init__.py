"""Composite jobs built from the operators: features, cleaning, training, scoring."""

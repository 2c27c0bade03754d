"""Ready-made applications built from the operators."""

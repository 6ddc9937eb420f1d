"""Column functions: text normalisation, featurizers and metrics."""

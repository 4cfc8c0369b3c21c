"""Column builders: confidence, weights, text, styling."""

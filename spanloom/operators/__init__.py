"""Thread, annotation, dataset and evaluation operators."""

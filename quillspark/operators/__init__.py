"""operators of the pipeline."""

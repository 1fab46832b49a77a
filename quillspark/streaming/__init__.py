"""streaming of the pipeline."""

"""sources of the pipeline."""

"""functions of the pipeline."""

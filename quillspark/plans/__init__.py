"""plans of the pipeline."""

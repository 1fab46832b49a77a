"""quillspark: a Spark-native document-to-narration pipeline."""

__version__ = "0.1.0"

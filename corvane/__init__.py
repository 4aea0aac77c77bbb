"""corvane: retrieval, evaluation and data-processing dataflows as Spark plans."""

__version__ = "0.1.0"

"""Text sanitisation and review analytics over DataFrames of documents."""

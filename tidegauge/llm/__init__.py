"""Text and vector operators for training corpora built from the research records."""

"""One-class detectors: fit on normal rows, score and label any rows."""

"""Reading samples and runs, writing features, predictions and reports."""

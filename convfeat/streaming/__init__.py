"""The same features and scores over a growing folder."""

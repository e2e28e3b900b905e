"""Training and scoring jobs."""

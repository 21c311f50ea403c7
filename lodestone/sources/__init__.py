"""Where documents come from and where indexes and results are kept."""

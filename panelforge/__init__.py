"""Factor research on security panels: every step is a DataFrame -> DataFrame function."""

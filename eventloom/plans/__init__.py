"""Complete reports, one function per report, returning DataFrames."""

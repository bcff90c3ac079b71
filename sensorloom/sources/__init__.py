"""Where readings come from: JSON bodies, typed files, the accepted log, the given tables."""

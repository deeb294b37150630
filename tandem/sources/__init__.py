"""Table loading, derived fixtures, file scans and sinks."""

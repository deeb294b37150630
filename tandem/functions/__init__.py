"""Column-level functions (pure expressions; all JVM-side unless noted)."""

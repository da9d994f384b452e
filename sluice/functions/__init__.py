"""Column functions: text, language, url.  All are built from JVM-side expressions."""

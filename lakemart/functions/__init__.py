"""Column expressions. No Python UDF: everything stays in the JVM."""

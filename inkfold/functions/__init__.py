"""Column expressions: every scalar rule of the engine, evaluated inside the JVM."""

"""Column-level building blocks; everything here stays inside the JVM unless it says so."""

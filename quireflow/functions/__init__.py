"""Column expressions; none of them leaves the JVM but the similarity scorer."""

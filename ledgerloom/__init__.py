"""Customer analytics over transaction lines, written as Spark DataFrame programs."""

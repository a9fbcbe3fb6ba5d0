"""Session-lifecycle analytics as declarative Spark plans."""

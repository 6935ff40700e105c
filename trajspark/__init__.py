"""Agent-trajectory analytics on Spark: plain DataFrame and SQL plans."""

"""Analytics on small Boolean threshold networks, written as Spark DataFrame and SQL plans."""

"""Order-flow analytics on Spark: daily trade counts, PIN, AdjPIN and VPIN as DataFrame jobs."""

"""Analytics over product and discussion feeds, as Spark jobs."""

"""Ready-made plans: the test tables as sales data, and the query registry."""

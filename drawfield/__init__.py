"""Analytics over posterior draws kept on a month x cell grid, written for Spark."""

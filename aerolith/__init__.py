"""Analytics over aircraft positions from receivers, as Spark DataFrame operators."""

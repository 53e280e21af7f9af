"""Analytics over symbol sequences and the evidence about them, as Spark DataFrame operators."""

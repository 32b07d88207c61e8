"""Analytics over traces of tool-using agents, as Spark DataFrame operators."""

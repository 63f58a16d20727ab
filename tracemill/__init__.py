"""Analytics over evaluation runs of code-generating models, on PySpark."""

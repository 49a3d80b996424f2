"""Questions about property graphs and the text attached to them, as Spark DataFrame plans."""

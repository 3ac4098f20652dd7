"""Column to Column functions; none needs Python on the executors."""

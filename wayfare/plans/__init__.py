"""Plan building blocks that keep global orders and long iterations distributed."""

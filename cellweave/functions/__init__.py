"""Column functions: cell algebra and text of the sentences."""

"""Column functions over text, dates, amounts and links."""

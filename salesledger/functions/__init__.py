"""Column expressions: money, dates, text and the labels of a sale."""

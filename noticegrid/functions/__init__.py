"""Column -> Column building blocks (text, dates, money, similarity, markup)."""

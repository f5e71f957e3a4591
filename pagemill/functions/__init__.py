"""Column -> Column building blocks; nothing here triggers a job or a shuffle."""

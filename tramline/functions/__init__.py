"""Column functions: clock times, geography, colours and text."""

"""Column expressions: codes, choices, rewards, text answers, statistics of one row."""

"""Column expressions and small frames: keys, parsing, metrics, Zipf."""

"""Column expressions over vectors, texts and nested values."""

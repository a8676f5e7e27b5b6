"""Column expressions: normalisation curves and text helpers."""

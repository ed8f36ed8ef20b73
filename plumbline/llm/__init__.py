"""Training-data operators: ten corpus operators that share numpy text helpers."""

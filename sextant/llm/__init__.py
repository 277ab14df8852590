"""Operators that prepare training data from texts and source code. Nothing else in the library imports this."""

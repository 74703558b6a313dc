"""Operators that prepare text for language-model training. Nothing else in docloom imports this subpackage."""

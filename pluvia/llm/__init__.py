"""Operators that prepare large text corpora for training. Nothing outside imports them."""

"""Column functions built from Spark's own expressions."""

from .hashing import chance, draw, order_key
from .labels import argmax, id_to_label, softmax
from .text import (
    char_span,
    chars,
    hyphen_to_space,
    normalise_text,
    strip_chars,
    word_count,
    words,
)
from .vectors import cosine, dot, l2_norm, rounded, squared_l2

__all__ = [
    "argmax", "chance", "char_span", "chars", "cosine", "dot", "draw", "hyphen_to_space",
    "id_to_label", "l2_norm", "normalise_text", "order_key", "rounded", "softmax",
    "squared_l2", "strip_chars", "word_count", "words",
]

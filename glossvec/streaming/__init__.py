"""No streaming operators: the row-wise filters and expressions of this package hold no state,
so they run unchanged on a streaming DataFrame (see tests/test_streaming.py)."""

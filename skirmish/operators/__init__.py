"""Operators over DataFrames: ``filters`` (B), ``joins`` (C), ``reports`` (G, D),
``ordered`` (E, F), ``maintain`` (I), ``replay`` (A5, K1, C3)."""

"""Column functions: ``scalars`` (H), ``ranges`` (H14–H16, H28), ``kungfu``."""

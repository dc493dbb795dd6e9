"""Inputs and outputs: ``tables`` (A1–A3), ``dimension`` (A4, F7), ``sinks`` (A6–A9),
``payloads`` (J1–J10), ``fixtures`` (domain tables derived from the driver tables)."""

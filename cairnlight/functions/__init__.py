"""Part of cairnlight."""

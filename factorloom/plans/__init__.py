"""From formula text to plans: reading, checking, normalising and compiling."""

"""Operators for preparing training text, one module each; `queries` lists what they register."""

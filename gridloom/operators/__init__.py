"""Relational and kernel operators on labelled grids."""

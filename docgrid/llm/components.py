"""Connected components of a large edge table; the work is that of the rest of the library."""

from docgrid.operators.stars import MOST_ROUNDS, connected_components

__all__ = ["MOST_ROUNDS", "connected_components"]

"""Sources: the star model (stored, derived or materialised), dirty variants, session logs."""

from starledger.sources.star import SalesModel, build_star, derive_star, load_star, materialize_star, write_star

__all__ = ["SalesModel", "build_star", "derive_star", "load_star", "materialize_star", "write_star"]

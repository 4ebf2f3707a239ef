"""Queries over the driver tables; importing a module registers its queries in catalogue."""

from rasterloom.plans import catalogue, places, seasons, sites

__all__ = ["catalogue", "places", "seasons", "sites"]

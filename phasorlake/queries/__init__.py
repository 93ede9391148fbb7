"""The engine's queries and their SQL, by name."""

from phasorlake.queries import fields, files, place, spatial, stateful, studies, symbolic
from phasorlake.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "fields", "files", "place", "spatial", "stateful", "studies", "symbolic"]

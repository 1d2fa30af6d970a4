"""All registered queries: importing the modules fills the register."""

from ledgernet.catalog import detect, graph, ingest, stream  # noqa: F401
from ledgernet.catalog.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""The registered queries, by kind of operator, with their SQL twins."""

from . import answers, files, ingest, records, relational, retrieval, scalars, state
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answers", "files", "ingest", "records", "relational", "retrieval", "scalars", "state"]

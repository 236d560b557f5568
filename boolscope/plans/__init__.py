"""Queries; importing the package registers them all."""

from . import graphs, larger, networks, storage, texts, vectors  # noqa: F401  these register their queries
from .oracles import ORACLES
from .registry import ORACLES as REGISTERED
from .registry import QUERIES

REGISTERED |= {name: text for name, text in ORACLES.items() if name in QUERIES}

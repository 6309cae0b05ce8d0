"""All registered queries. Importing this package fills the registry."""
from . import extraction, flows, history, pages, postings, scalars  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

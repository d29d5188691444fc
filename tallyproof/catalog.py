"""All registered queries of the library and their SQL twins."""

from .plans import connectors, diagnostics, evidence, records, review, streams, validation  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

"""All named queries; importing a module registers its queries."""

from registry import catalogues, figures, markup, platforms, quality, scores, streams, texts  # noqa: F401
from registry.base import ORACLES, QUERIES  # noqa: F401

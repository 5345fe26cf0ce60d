"""Imports every module of registered queries."""

from stylegraph.registry import (authors, evaluation, plugins, selection, sources, space,  # noqa: F401
                                 text, vocabulary)  # noqa: F401
from stylegraph.registry.base import QUERIES, SQL  # noqa: F401

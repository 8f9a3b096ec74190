"""Hop-distance analytics of directed graphs that are stored as ordinary tables."""

from trailgraph.sources.graphs import Graph

__all__ = ["Graph"]

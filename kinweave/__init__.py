"""kinweave: code-knowledge-graph analytics written as Spark DataFrame jobs."""

from kinweave.graph import CodeGraph

__all__ = ["CodeGraph"]

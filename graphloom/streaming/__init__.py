"""Structured Streaming: incremental maintenance of a graph store."""

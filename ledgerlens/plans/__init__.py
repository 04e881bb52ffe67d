"""Compositions of operators: facts, query specs, the gated analysis run, registered queries."""

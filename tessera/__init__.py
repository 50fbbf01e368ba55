"""Tessera: a temporal knowledge-graph analytics engine written as Spark jobs."""

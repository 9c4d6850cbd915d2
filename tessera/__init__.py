"""A retrieval and knowledge-graph analytics engine expressed as Spark plans."""

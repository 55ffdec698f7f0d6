"""Semantic retrieval and recall over collections of notes, as ordinary Spark plans."""

"""Spark jobs for building, searching and evaluating text knowledge bases, and for learner and trace analytics."""

"""Foliant: a Spark engine that cleans, restructures and checks large corpora of Markdown documents."""

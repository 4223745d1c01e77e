"""arbora: treebank analytics as Spark jobs (see README.md)."""

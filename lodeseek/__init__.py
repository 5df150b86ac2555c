"""Lodeseek: semantic code search and corpus maintenance as Spark jobs."""

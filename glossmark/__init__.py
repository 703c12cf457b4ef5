"""Spark jobs for multilingual experiment analytics."""

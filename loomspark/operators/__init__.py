"""Relational operators over crawl, workflow, session and benchmark tables."""

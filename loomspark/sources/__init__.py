"""Readers of pages, sitemaps, robots files, search results and documents."""

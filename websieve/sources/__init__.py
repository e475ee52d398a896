"""Packets, pages, feeds and blobs."""

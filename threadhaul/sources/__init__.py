"""Readers: files, roster, landed pages and the paged source."""

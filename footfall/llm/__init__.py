"""Operators for preparing training corpora at scale; nothing outside this subpackage imports it."""

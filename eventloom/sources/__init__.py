"""Readers, loaders, publishing, exports and storage reports."""

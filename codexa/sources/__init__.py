"""Readers: tables, file catalogues and sidecar documents."""

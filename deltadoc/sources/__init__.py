"""Readers that turn raw files into page and block tables, and the sinks."""

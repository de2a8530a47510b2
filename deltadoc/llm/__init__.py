"""Operators for preparing training data: packing, media, archives, filters, near copies, search, mixing."""

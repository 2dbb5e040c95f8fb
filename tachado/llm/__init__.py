"""Operators for preparing training data: classifying, deduplicating, scanning, formatting, packing and writing documents."""

"""Readers for landed feeds and the contracts they must satisfy."""

"""Subpackage of peakloom."""

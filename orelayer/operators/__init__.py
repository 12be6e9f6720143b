"""Operators: frames in, frames out, no action inside."""

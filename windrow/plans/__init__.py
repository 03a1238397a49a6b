"""Whole runs composed from the operators. Frames in, frames out; writing is left to the caller."""

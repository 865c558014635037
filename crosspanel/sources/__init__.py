"""Readers and writers: raw extracts, panels, run artefacts, the signal catalogue."""

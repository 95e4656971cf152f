"""Operators for building training data from a catalogue; nothing else in the library imports this package."""

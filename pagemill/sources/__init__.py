"""Readers, decoders, the page shredder and sinks."""

"""Whole feature builds and runs composed from the operators."""

"""Whole jobs, and the track tables that tests and registered queries work on."""

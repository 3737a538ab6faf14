"""Streaming: the audited tool has no streaming surface (no watermarks, windows over
time, or state stores), so nothing is built here.  Every job is a batch DataFrame job;
see README.md for the reasoning."""

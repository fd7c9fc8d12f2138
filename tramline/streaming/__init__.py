"""Structured Streaming over the static timetable (an extension; the batch forms need none of it)."""

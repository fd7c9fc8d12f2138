"""Spark-native analytics for public-transport timetables and gridded urban data."""

"""Spark-native operators over telecom activity tables (calls, sessions, aliases, pairs)."""

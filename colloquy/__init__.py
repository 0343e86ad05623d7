"""Spark-native analysis of recorded, transcribed conversations."""

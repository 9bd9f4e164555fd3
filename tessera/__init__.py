"""Spark-native retrieval, planning and corpus analytics."""

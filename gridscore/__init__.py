"""Spark-native scoring of multi-channel recordings on a spatial grid."""

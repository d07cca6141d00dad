"""Spark-native engine for keyed entities, meshes and the fields on them."""

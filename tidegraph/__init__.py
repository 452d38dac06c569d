"""Spark-native RDF reasoning, SPARQL and RDF stream processing."""

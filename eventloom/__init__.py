"""Declarative analysis of event records with nested collections, compiled to Spark plans."""

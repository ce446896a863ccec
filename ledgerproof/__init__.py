"""Fact-grounding analytics over transaction tables and generated text, on Spark."""

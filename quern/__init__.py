"""Validation of JSON documents at scale against JSON Schema (draft-06), as Spark expressions."""

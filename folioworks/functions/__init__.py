"""Part of the document-triage engine."""

"""Reading, versioning and writing labelled text tables."""

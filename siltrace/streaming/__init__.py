"""Process control over streams."""

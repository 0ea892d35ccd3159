"""Label images to clean metadata, as DataFrame transformations."""

"""Reading landed feeds and archives, publishing result tables."""

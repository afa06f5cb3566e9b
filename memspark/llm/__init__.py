"""Training-data pipeline operators over document and embedding tables."""

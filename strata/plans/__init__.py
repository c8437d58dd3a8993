"""The pipeline, and the queries over the star-schema tables."""

"""Array, image and feature-table analytics on DataFrames."""

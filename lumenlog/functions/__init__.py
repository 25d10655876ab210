"""Column functions: parsing, masking, templates, similarity, time and address repair."""

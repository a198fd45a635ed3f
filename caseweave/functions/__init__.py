"""Column functions: extraction, normal forms and scores."""

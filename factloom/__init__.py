"""factloom."""

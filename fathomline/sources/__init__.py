"""Reading and writing files, and paged sources."""

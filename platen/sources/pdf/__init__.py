"""PDF files as relations."""

"""Part of platen."""

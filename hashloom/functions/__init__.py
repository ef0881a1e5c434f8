"""Part of hashloom."""

"""Part of boxloom; see README."""

"""Part of redactrail."""

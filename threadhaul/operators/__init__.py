"""Set-based operators of the export."""

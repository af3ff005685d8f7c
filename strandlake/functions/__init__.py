"""Part of strandlake; see README.md."""

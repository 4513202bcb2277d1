"""Column expressions: hashes, residue classes, losses, sparse and dense vectors."""

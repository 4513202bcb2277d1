"""Graph, sequence, learning and similarity operators."""

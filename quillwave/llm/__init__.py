"""Preparation of training data: cutoffs, collapsing, splits, tokens, packing, residue."""

"""Plans that put the column functions together: the operator registry and batch evaluation."""

"""Column functions and small kernels over sequences of segments."""

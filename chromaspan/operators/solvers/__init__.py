"""Two kernels for one row's colouring problem; they share no code."""

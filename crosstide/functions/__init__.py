"""What the expression language can say: column kernels and the functions built on them."""

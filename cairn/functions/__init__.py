"""Column functions: vectors, the linear congruential generator, characters and numbers in text."""

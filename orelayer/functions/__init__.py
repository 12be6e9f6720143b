"""Column expressions and small frame helpers shared by all operators."""

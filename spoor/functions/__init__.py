"""Column expressions shared by the operators. Everything here is a built-in
Spark expression, so it stays inside whole-stage code generation."""

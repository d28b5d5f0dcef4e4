"""Column functions: text, rules, identities and solvers."""

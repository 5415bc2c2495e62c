"""Plans composed of several operators."""

"""Complete flows and the registered queries built from the operators."""

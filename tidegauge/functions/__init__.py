"""Column-level helpers: rules, text, identifiers, calendar tags, returns."""

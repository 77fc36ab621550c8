"""Views over the driver tables and the registered queries built on them."""

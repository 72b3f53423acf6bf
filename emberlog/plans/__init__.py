"""Search requests and the logical plans built from them."""

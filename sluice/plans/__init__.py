"""Query descriptors, the function registry and the compiler."""

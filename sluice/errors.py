class CompileError(ValueError):
    """A query descriptor that cannot be turned into a plan; raised before anything runs."""

from . import files, sessions  # noqa: F401

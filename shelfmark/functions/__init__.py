from . import html, paths, replies, text  # noqa: F401

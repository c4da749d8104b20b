"""Named queries over the given tables."""

from importlib import import_module

FAMILIES = ("error_queries", "session_queries", "skill_queries", "note_queries", "retrieval_queries", "ledger_queries", "stream_queries", "source_queries")


def load():
    """Imports every query family and returns the registry."""
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
    return import_module(f"{__name__}.registry")

"""Brute-force accounts shared by the tests."""

from test_decontam import brute as _decontaminated
from test_simhash import brute_components, brute_fingerprint  # noqa: F401


def brute_decontaminated(rows, items):
    """Ids of the documents with a benchmark phrase."""
    return {r[0] for r in _decontaminated(rows, items) if r[5]}

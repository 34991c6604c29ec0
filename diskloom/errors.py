"""Errors that a query can end with. A read gives real bytes from the disk or one of these, never invented data."""


class EvidenceError(Exception):
    """Malformed or damaged evidence."""


class NotFound(EvidenceError):
    """No such path, partition or record."""


class Unsupported(EvidenceError):
    """Well-formed, but of a kind that is not read."""


class IsDirectory(EvidenceError):
    """File content was asked of a directory."""


class NotDirectory(EvidenceError):
    """A listing was asked of a file."""

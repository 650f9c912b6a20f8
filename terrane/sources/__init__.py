"""Tables in and out."""

from terrane.sources.session import Session, persist, release
from terrane.sources.writer import Writer

__all__ = ["Session", "Writer", "persist", "release"]

"""Settings from a TOML file."""

import tomllib
from dataclasses import dataclass, field


@dataclass
class Settings:
    """Folders by bucket, the seconds between scans (0: none), and whatever else the file holds."""

    buckets: dict[str, str] = field(default_factory=dict)
    poll_seconds: int = 60
    other: dict = field(default_factory=dict)


def load(path: str) -> Settings:
    """The settings of a file; unknown entries are kept in other."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    return Settings(dict(found.pop("buckets", {})), int(found.pop("poll_seconds", 60)), found)

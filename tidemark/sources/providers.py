"""What a market data provider says of itself. Code asks these fields, never the provider's name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

#: How dense a feed's bars are, and what its volumes cover.
DENSITIES, SCOPES = ("dense", "sparse"), ("consolidated", "single_venue")


@dataclass(frozen=True)
class Capabilities:
    provider: str
    source_label: str = ""
    feed: str = "sip"
    feed_scope: str = "consolidated"
    bar_density: str = "dense"
    adjustment: str = "raw"
    timespans: tuple[str, ...] = ("minute",)
    history_start: dt.date | None = None
    extended_hours: bool = True
    credential_names: tuple[str, ...] = ()
    #: Where these claims come from: documentation, or what was seen live.
    basis: str = ""

    def __post_init__(self) -> None:
        if self.bar_density not in DENSITIES or self.feed_scope not in SCOPES:
            raise ValueError(f"{self.provider}: density {self.bar_density}, scope {self.feed_scope}")

    def identity(self) -> dict[str, str]:
        """The provenance that stored bars carry."""
        return {"source": self.source_label or self.provider.upper(), "feed": self.feed, "feed_scope": self.feed_scope, "adjustment": self.adjustment}


_made: dict[str, Callable[[], object]] = {}


def register(name: str, make: Callable[[], object]) -> None:
    """Names a provider; a name is taken once."""
    if name in _made:
        raise ValueError(f"{name} is registered")
    _made[name] = make


def provider(name: str) -> object:
    if name not in _made:
        raise KeyError(f"no provider {name}; there are {sorted(_made)}")
    return _made[name]()

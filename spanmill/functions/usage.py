"""Why a model call has no token counts, and which outbound hosts a list admits; one Arrow batch at a time."""

from __future__ import annotations

import ipaddress
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from spanmill.functions.attributes import JSON, is_llm

COUNTS = ["prompt_tokens", "completion_tokens", "total_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]
LEVELS = 4


def mentions_tokens(value, levels: int = LEVELS) -> bool:
    """Whether an object among the first levels of a JSON value has a key with "token" in it and a number or text there."""
    layer = [value]
    for _ in range(levels):
        below = []
        for own in layer:
            if isinstance(own, dict):
                if any("token" in k.lower() and isinstance(v, (int, float, str)) and not isinstance(v, bool) for k, v in own.items()):
                    return True
                below += own.values()
            elif isinstance(own, list):
                below += own
        layer = below
    return False


def nested_usage(attributes: str | None) -> bool:
    """Whether an attribute named for usage or tokens holds token counts inside."""
    try:
        held = json.loads(attributes or "{}")
    except ValueError:
        return False
    return any(("usage" in k.lower() or "token" in k.lower()) and mentions_tokens(v) for k, v in held.items())


@F.pandas_udf(BooleanType())
def _nested(text: pd.Series) -> pd.Series:
    return text.map(nested_usage)


def usage_missing() -> Column:
    """NULL where counts are there or the span is no model call; else unparsed-nesting or no-usage-field."""
    none = F.coalesce(*(F.col(c) for c in COUNTS)).isNull()
    return F.when(is_llm() & none, F.when(_nested(F.col(JSON)), "unparsed-nesting").otherwise("no-usage-field"))


class Egress:
    """Hosts, addresses and networks that may be called; offline admits none, an empty list all."""

    def __init__(self, allow: list[str] = (), offline: bool = False):
        if offline and allow:
            raise ValueError("offline makes no call at all, so a list has no effect: give one or the other")
        self.offline, self.hosts, self.networks = offline, set(), []
        for entry in allow:
            try:
                self.networks.append(ipaddress.ip_network(entry.strip().strip("[]"), strict=False))
            except ValueError:
                if "/" in entry or not entry.strip():
                    raise ValueError(f"not a host, address or network: {entry!r}") from None
                self.hosts.add(entry.strip().lower())

    def admit(self, host: str, addresses: list[str]) -> str | None:
        """The address to call: the first that is admitted; all of a listed host's are."""
        if self.offline:
            return None
        open_ = not self.hosts and not self.networks or host.strip("[]").lower() in self.hosts
        return next((a for a in addresses if open_ or any(ipaddress.ip_address(a) in n for n in self.networks)), None)


def admitted(policy: Egress, host: Column, addresses: Column) -> Column:
    @F.pandas_udf("string")
    def run(hosts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else policy.admit(h, [] if a is None else list(a)) for h, a in zip(hosts, found)], dtype="object")

    return run(host, addresses)

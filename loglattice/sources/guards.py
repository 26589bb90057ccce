"""Checks on the driver before anything is read or sent: path roots and webhook addresses."""

from __future__ import annotations

import ipaddress
import os
import socket
from urllib.parse import urlsplit


def within_roots(path: str, roots: list[str]) -> str:
    """The real path, if it is a root or below one; links are resolved. Else an error."""
    real = os.path.realpath(path)
    for root in {os.path.realpath(r) for r in roots}:
        if real == root or real.startswith(root.rstrip("/") + "/"):
            return real
    raise PermissionError(f"outside of the allowed folders: {path}")


def check_webhook(url: str, resolve=socket.getaddrinfo) -> str:
    """The address, if it is http(s) and every host address is public. Else an error."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError(f"not an http address: {url}")
    try:
        found = [ipaddress.ip_address(parts.hostname)]
    except ValueError:
        found = [ipaddress.ip_address(r[4][0]) for r in resolve(parts.hostname, parts.port or 80)]
    for a in found:
        if not a.is_global or a.is_multicast:
            raise ValueError(f"an internal address: {url}")
    return url


def effective(override: str | None, configured: str | None, locked: bool) -> str | None:
    """A request's own address unless that is locked; none given means the configured one, an empty one means off."""
    if locked or override is None:
        return configured
    return override or None

"""http and https URLs as browsers read them (the URL standard's rules for special schemes): parsing against a base, and one spelling for equal URLs."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from dataclasses import dataclass, replace
from urllib.parse import unquote_to_bytes

#: Ports that go unsaid.
DEFAULT_PORTS = {"http": 80, "https": 443}
#: ASCII characters that are written as %XX in each part, besides controls and all that is not ASCII.
_IN_QUERY = frozenset(" \"#<>'")
_IN_PATH = frozenset(' "#<>?^`{}')
_IN_USER = frozenset(' "#<>?^`{}/:;=@[\\]|')
#: Fixed value: characters that no host may hold once its escapes are read.
_NO_HOST = re.compile("[\x00-\x20\"#%/:<>?@\\[\\\\\\]^`{|}\x7f]")
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_EDGE = "".join(map(chr, range(0x21)))
_DOT = frozenset((".", "%2e"))
_DOTS = frozenset(("..", ".%2e", "%2e.", "%2e%2e"))


@dataclass(frozen=True)
class WebUrl:
    """Parts of a URL as they are written out; path begins with a slash."""

    scheme: str
    user: str
    host: str
    port: int | None
    path: str
    query: str | None
    fragment: str | None

    def __str__(self) -> str:
        user = f"{self.user}@" if self.user else ""
        port = "" if self.port is None else f":{self.port}"
        query = "" if self.query is None else f"?{self.query}"
        fragment = "" if self.fragment is None else f"#{self.fragment}"
        return f"{self.scheme}://{user}{self.host}{port}{self.path}{query}{fragment}"


def _escape(text: str, also: frozenset[str]) -> str:
    return "".join(c if " " <= c < "\x7f" and c not in also else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _number(text: str) -> int | None:
    """A part of an IPv4 address: decimal, octal with a leading 0 or hexadecimal with 0x."""
    digits, base = (text[2:], 16) if text[:2].lower() == "0x" else (text[1:], 8) if len(text) > 1 and text[0] == "0" else (text, 10)
    if not digits:
        return 0 if base == 16 else None
    if not all(c in "0123456789abcdefABCDEF"[: {8: 8, 10: 10, 16: 22}[base]] for c in digits):
        return None
    return int(digits, base)


def _ipv4(host: str) -> str | None:
    """The dotted form of a host that ends in a number; None where it is no address."""
    numbers = [_number(p) for p in host.removesuffix(".").split(".")]
    if len(numbers) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n * 256 ** (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _ipv6(text: str) -> str | None:
    try:
        words = ipaddress.IPv6Address(text).packed
    except ValueError:
        return None
    if "%" in text:
        return None
    groups = [f"{int.from_bytes(words[i : i + 2]):x}" for i in range(0, 16, 2)]
    # The first longest row of zeros, of two at least, is left out.
    rows = [(len(m[0]), -m.start()) for m in re.finditer("0+", "".join("0" if g == "0" else "x" for g in groups))]
    size, start = max(rows, default=(0, 0))
    if size < 2:
        return f"[{':'.join(groups)}]"
    return f"[{':'.join(groups[:-start])}::{':'.join(groups[-start + size :])}]"


def _label(label: str) -> str:
    return label if label.isascii() else "xn--" + label.encode("punycode").decode()


def _host(text: str) -> str | None:
    if text.startswith("["):
        return _ipv6(text[1:-1]) if text.endswith("]") else None
    try:
        name = unquote_to_bytes(text).decode()
    except UnicodeDecodeError:
        return None
    if not name.isascii():
        # Wide, joined and upper-case forms of one name are one name; soft hyphens and joiners are no letters.
        name = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", re.sub("[­​⁠﻿]", "", name)).lower())
        name = ".".join(_label(x) for x in re.split("[.。．｡]", name))
    name = name.lower()
    if not name or _NO_HOST.search(name):
        return None
    last = name.removesuffix(".").rpartition(".")[2]
    return _ipv4(name) if last and (last.isdecimal() or re.fullmatch("0x[0-9a-f]*", last)) else name


def _authority(text: str) -> tuple[str, str, int | None] | None:
    """(user, host, port) with the port still there, or None where it is none."""
    user, _, rest = text.rpartition("@")
    found = re.fullmatch(r"(\[.*\]|[^:]*)(?::([0-9]*))?", rest, re.S)
    host = _host(found[1]) if found and found[1] else None
    port = int(found[2]) if found and found[2] else None
    if host is None or (port is not None and port > 65535):
        return None
    name, colon, word = user.partition(":")
    name, word = _escape(name, _IN_USER), _escape(word, _IN_USER)
    return name + (f":{word}" if word else ""), host, port


def _path(text: str, before: list[str]) -> str:
    """A path's segments after those of `before`, backslashes as slashes, dots taken away."""
    out = list(before)
    pieces = re.split(r"[/\\]", text)
    for i, piece in enumerate(pieces):
        low, last = piece.lower(), i == len(pieces) - 1
        if low in _DOTS:
            del out[-1:]
        elif low not in _DOT:
            out.append(_escape(piece, _IN_PATH))
        if last and (low in _DOTS or low in _DOT):
            out.append("")
    return "/" + "/".join(out)


def parse(text: str, base: WebUrl | None = None) -> WebUrl | None:
    """The URL of a text, read against a base where it is relative; None for other schemes and for what is no URL."""
    text = re.sub("[\t\n\r]", "", text.strip(_EDGE))
    text, sharp, fragment = text.partition("#")
    fragment = _escape(fragment, frozenset(' "<>`')) if sharp else None
    named = _SCHEME.match(text)
    scheme = named[1].lower() if named else base.scheme if base else ""
    if scheme not in DEFAULT_PORTS:
        return None
    rest = text[named.end() :] if named else text
    relative = base is not None and base.scheme == scheme and not re.match(r"[/\\]{2}", rest)
    rest, mark, query = rest.partition("?")
    query = _escape(query, _IN_QUERY) if mark else None
    if relative:
        kept = [] if re.match(r"[/\\]", rest) else base.path[1:].split("/")[:-1]
        if not rest:
            return replace(base, query=query if mark else base.query, fragment=fragment)
        return replace(base, path=_path(re.sub(r"^[/\\]", "", rest), kept), query=query, fragment=fragment)
    found = re.fullmatch(r"[/\\]*([^/\\]*)(?:[/\\](.*))?", rest, re.S)
    at = _authority(found[1]) if found and found[1] else None
    if at is None:
        return None
    user, host, port = at
    return WebUrl(scheme, user, host, None if port == DEFAULT_PORTS[scheme] else port, _path(found[2] or "", []), query, fragment)

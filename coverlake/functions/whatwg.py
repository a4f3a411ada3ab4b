"""Addresses by the rules of the URL standard (url.spec.whatwg.org), as browsers read them: lenient slashes, dot segments, hosts in
other scripts, numbers as IPv4 addresses, and what is percent-encoded where.

Not covered: relative addresses, drive letters of ``file``, and hosts of schemes that the standard does not call special, which are
kept as they are.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote_to_bytes

# Fixed values of the standard: ports of the special schemes, and the characters that are encoded besides controls and non-ASCII.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
FRAGMENT = ' "<>`'
QUERY = ' "#<>'
SPECIAL_QUERY = QUERY + "'"
PATH = QUERY + "?^`{}"
USERINFO = PATH + "/:;=@[\\]|"
FORBIDDEN_HOST = "\0\t\n\r #/:<>?@[\\]^|"
FORBIDDEN_DOMAIN = FORBIDDEN_HOST + "%\x7f" + "".join(map(chr, range(0x20)))
FORBIDDEN_IN_DOMAIN = frozenset(FORBIDDEN_DOMAIN)
ONE_DOT, TWO_DOTS = {".", "%2e"}, {"..", ".%2e", "%2e.", "%2e%2e"}
SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
EDGES = "".join(map(chr, range(0x21)))


@dataclass
class Url:
    scheme: str
    user: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    path: str = ""
    query: str | None = None
    fragment: str | None = None

    def __str__(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            login = self.user + (f":{self.password}" if self.password else "") + "@" if self.user or self.password else ""
            out += "//" + login + self.host + (f":{self.port}" if self.port is not None else "")
        return out + self.path + (f"?{self.query}" if self.query is not None else "") + (
            f"#{self.fragment}" if self.fragment is not None else ""
        )


@lru_cache(maxsize=64)
def unsafe(chosen: str) -> re.Pattern:
    """What is encoded: all but printable ASCII, and the characters chosen."""
    return re.compile(f"[^ -~]|[{re.escape(chosen)}]" if chosen else "[^ -~]")


def encoded(text: str, chosen: str) -> str:
    if not unsafe(chosen).search(text):
        return text
    return "".join(c if " " <= c <= "~" and c not in chosen else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def ipv4_part(text: str) -> int | None:
    digits, base = text, 10
    if text[:2].lower() == "0x":
        digits, base = text[2:], 16
    elif len(text) > 1 and text[0] == "0":
        digits, base = text[1:], 8
    if not digits:
        return 0
    allowed = "0123456789abcdefABCDEF"[: {8: 8, 10: 10, 16: 22}[base]]
    return int(digits, base) if all(c in allowed for c in digits) else None


def ends_in_number(host: str) -> bool:
    parts = host.split(".")
    if not parts[-1] and len(parts) > 1:
        parts.pop()
    return parts[-1].isascii() and parts[-1].isdigit() or parts[-1][:2].lower() == "0x" and ipv4_part(parts[-1]) is not None


def ipv4(host: str) -> str:
    parts = host.split(".")
    if not parts[-1] and len(parts) > 1:
        parts.pop()
    numbers = [ipv4_part(p) if p else None for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError(host)
    value = numbers[-1] + sum(n * 256 ** (3 - k) for k, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def label(text: str) -> str:
    """One part of a domain in ASCII."""
    if text.isascii():
        return text
    return "xn--" + text.encode("punycode").decode("ascii")


@lru_cache(maxsize=1 << 14)
def domain(text: str) -> str:
    if text.isascii():
        return text.lower()
    mapped = "".join("" if c in "­​⁠﻿" or unicodedata.category(c) == "Cf" and c not in "‌‍" else c for c in text)
    # small letters as names have them: case folding but for those that the rules for names keep apart
    small = "".join(c if c in "ßς‌‍" else c.casefold() for c in mapped.replace("ẞ", "ss"))
    small = unicodedata.normalize(
        "NFC", "".join(c if c in "ßς" else unicodedata.normalize("NFKC", c).casefold() for c in unicodedata.normalize("NFC", small))
    )
    parts = re.split("[.。．｡]", small)
    return ".".join(map(label, parts))


def host_of(text: str, special: bool) -> str:
    if text.startswith("["):
        if not text.endswith("]"):
            raise ValueError(text)
        address = ipaddress.IPv6Address(text[1:-1])
        if address.scope_id:
            raise ValueError(text)
        whole = str(address)
        if "." in whole:  # the standard writes all eight groups as hexadecimal numbers
            high, low = int(address) >> 16 & 0xFFFF, int(address) & 0xFFFF
            whole = f"::ffff:{high:x}:{low:x}"
        return f"[{whole}]"
    if not special:
        if any(c in FORBIDDEN_HOST for c in text):
            raise ValueError(text)
        return encoded(text, "")
    ascii_ = domain(unquote_to_bytes(text).decode("utf-8", "replace"))
    if not ascii_ or not FORBIDDEN_IN_DOMAIN.isdisjoint(ascii_):
        raise ValueError(text)
    return ipv4(ascii_) if ends_in_number(ascii_) else ascii_


def segments(path: str, special: bool) -> str:
    """A path without dot segments, encoded."""
    out: list[str] = []
    parts = re.split(r"[/\\]" if special else "/", path)
    if parts and not parts[0]:
        parts = parts[1:]
    for k, part in enumerate(parts):
        last, low = k == len(parts) - 1, part.lower()
        if low in TWO_DOTS:
            if out:
                out.pop()
            if last:
                out.append("")
        elif low in ONE_DOT:
            if last:
                out.append("")
        else:
            out.append(encoded(part, PATH))
    return "/" + "/".join(out)


def parse(text: str) -> Url:
    """The address; ValueError if it is none."""
    text = re.sub(r"[\t\n\r]", "", text.strip(EDGES))
    m = SCHEME.match(text)
    if not m:
        raise ValueError(text)
    url, rest = Url(m[1].lower()), text[m.end() :]
    rest, mark, fragment = rest.partition("#")
    if mark:
        url.fragment = encoded(fragment, FRAGMENT)
    rest, mark, query = rest.partition("?")
    special = url.scheme in PORTS
    if mark:
        url.query = encoded(query, SPECIAL_QUERY if special else QUERY)
    if special and url.scheme != "file":
        rest = re.sub(r"^[/\\]*", "", rest)
    elif rest.startswith("//") or special and re.match(r"[/\\]{2}", rest):
        rest = rest[2:]
    else:
        if special:
            url.host, url.path = "", segments(rest, True)
        else:
            url.path = segments(rest, False) if rest.startswith("/") else encoded(rest, "")
        return url
    end = re.search(r"[/\\]" if special else "/", rest)
    place, path = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    login, at, place = place.rpartition("@")
    if at:
        user, _, password = login.partition(":")
        url.user, url.password = encoded(user, USERINFO), encoded(password, USERINFO)
    port = re.search(r":([0-9]*)$", place)
    if port and not place.endswith("]"):
        place = place[: port.start()]
        if port[1]:
            number = int(port[1])
            if number > 65535:
                raise ValueError(text)
            url.port = None if PORTS.get(url.scheme) == number else number
    if url.scheme == "file":
        url.host = "" if place.lower() in ("", "localhost") else host_of(place, True)
    else:
        if special and not place or at and not place:
            raise ValueError(text)
        url.host = host_of(place, special) if place else ""
    url.path = segments(path, special) if path or special else ""
    return url


def pairs(query: str | None) -> list[tuple[str, str]]:
    """Names and values of a query."""
    out = []
    for part in filter(None, (query or "").split("&")):
        name, _, value = part.partition("=")
        out.append(tuple(unquote_to_bytes(x.replace("+", " ")).decode("utf-8", "replace") for x in (name, value)))
    return out


PLAIN = re.compile("[A-Za-z0-9*._-]*")


def written(values: list[tuple[str, str]]) -> str:
    plain = re.compile(rb"[A-Za-z0-9*._-]")

    def one(text: str) -> str:
        if PLAIN.fullmatch(text):
            return text
        return "".join("+" if b == 32 else chr(b) if plain.match(bytes([b])) else f"%{b:02X}" for b in text.encode("utf-8", "replace"))

    return "&".join(f"{one(k)}={one(v)}" for k, v in values)


#: A fixed value: marks in the order in which names are sorted; digits and letters follow.
MARKS = " _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"


@lru_cache(maxsize=1 << 12)
def order(text: str) -> tuple:
    """Names sort by letters first, then by accents, then small letters before capitals."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return [
        (0, MARKS.index(c)) if c in MARKS else (1, ord(c)) if c.isdigit() else (2, ord(c)) for c in bare.casefold()
    ], unicodedata.normalize("NFD", text).casefold(), text.swapcase()

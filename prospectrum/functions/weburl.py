"""Web addresses read as browsers read them: a helper for one text.

Blanks around an address, back slashes, percent signs, dot segments, ports,
user names, IPv4 numbers in any base, IPv6 and international hosts are taken
as the URL standard says. Of the rules for international hosts, those on
writing direction and on joiners are left out.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)", re.DOTALL)
_BLANKS = "".join(map(chr, range(0x21)))
#: Scheme, host and path of an address without user, port, escapes, blanks or dot segments; the host ends in letters.
PLAIN = re.compile(r"(?:(https?)://)?((?:[A-Za-z0-9-]+\.)+[A-Za-z]+)((?:/(?:[A-Za-z0-9_~-][A-Za-z0-9_~.-]*)?)*)(?:[?#][!-~]*)?")
_DRIVE = re.compile(r"[A-Za-z][:|]")
_NO_HOST = re.compile(r"[\x00\t\n\r #/:<>?@\[\\\]^|]")
_NO_DOMAIN = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")
_STOPS = re.compile("[\u3002\uff0e\uff61]")
_DROPPED = re.compile("[\u00ad\u034f\u180b-\u180d\u180f\u200b\u2060\u2064\ufe00-\ufe0f\ufeff]")
#: Letters that keep their form where others fold.
_KEPT = "\u00df\u03c2\u200c\u200d"
_PATH_SET, _USER_SET = '"#<>?^`{}', '"#<>?^`{}/:;=@[\\]|'


class Url(NamedTuple):
    scheme: str
    user: str
    password: str
    host: str
    port: int | None
    path: str

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" + (f":{self.port}" if self.port is not None else "")

    def without_query(self) -> str:
        secret = f":{self.password}" if self.password else ""
        user = f"{self.user}{secret}@" if self.user or secret else ""
        return f"{self.scheme}://{user}{self.host}" + (f":{self.port}" if self.port is not None else "") + self.path


def encoded(text: str, chosen: str) -> str:
    """Controls, blanks, what is beyond ASCII and the chosen characters as %XX."""
    return "".join(c if "!" <= c <= "~" and c not in chosen else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _label(label: str) -> str | None:
    """A label of a host in ASCII."""
    if label.startswith("xn--"):
        try:
            plain = label[4:].encode("ascii").decode("punycode")
        except (UnicodeError, ValueError):
            return None
        return label if plain and not plain.isascii() and _label(plain) == label else None
    if label.isascii():
        return label
    if unicodedata.category(label[0])[0] == "M" or any(unicodedata.category(c) in ("Cc", "Cs", "Co", "Cn", "Zs", "Zl", "Zp") or c == "\ufffd" for c in label):
        return None
    return "xn--" + label.encode("punycode").decode("ascii")


def ascii_host(text: str) -> str | None:
    """A host name in lower-case ASCII; international labels in Bootstring."""
    folded = text.lower() if text.isascii() else ""
    if not text.isascii():
        normal = unicodedata.normalize("NFKC", _DROPPED.sub("", _STOPS.sub(".", text)))
        folded = unicodedata.normalize("NFKC", "".join(c if c in _KEPT else c.casefold() for c in normal))
    labels = [_label(x) if x else "" for x in folded.split(".")]
    return None if None in labels else ".".join(labels)


def _number(text: str) -> int | None:
    """An IPv4 part: decimal, 0x hexadecimal or 0 octal."""
    base = 16 if text[:2].lower() == "0x" else 8 if len(text) > 1 and text[0] == "0" else 10
    digits = text[2:] if base == 16 else text[1:] if base == 8 else text
    if not text or not all(c in "0123456789abcdef"[:base] for c in digits.lower()):
        return None
    return int(digits, base) if digits else 0


def _ipv4(host: str) -> str | None:
    parts = host.split(".")
    if len(parts) > 1 and not parts[-1]:
        parts.pop()
    numbers = [_number(p) for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _ipv6(text: str) -> str | None:
    try:
        value = int(ipaddress.IPv6Address(text)) if "%" not in text else None
    except ValueError:
        value = None
    if value is None:
        return None
    pieces = [value >> 16 * i & 0xFFFF for i in reversed(range(8))]
    runs = re.finditer("0{2,}", "".join("1" if p else "0" for p in pieces))
    longest = max(runs, key=lambda m: (m.end() - m.start(), -m.start()), default=None)
    hexes = [f"{p:x}" for p in pieces]
    if longest is None:
        return f"[{':'.join(hexes)}]"
    return f"[{':'.join(hexes[: longest.start()])}::{':'.join(hexes[longest.end() :])}]"


def host_of(text: str, special: bool) -> str | None:
    """A host as written between user name and port; None if it is none."""
    if text.startswith("["):
        return _ipv6(text[1:-1]) if text.endswith("]") else None
    if not special:
        return None if _NO_HOST.search(text) else encoded(text, "")
    host = ascii_host(unquote_to_bytes(text).decode("utf-8", "replace") if "%" in text else text)
    if not host or _NO_DOMAIN.search(host):
        return None
    parts = host.split(".")
    last = parts[-2] if not parts[-1] and len(parts) > 1 else parts[-1]
    is_number = last != "" and (last.isdigit() or (last.startswith("0x") and _number(last) is not None))
    return _ipv4(host) if is_number else host


def _path(text: str, special: bool) -> str:
    """A path without dot segments."""
    if not text and not special:
        return ""
    pieces, out = re.split(r"[/\\]" if special else "/", text.removeprefix("/") if text[:1] != "\\" or not special else text[1:]), []
    for i, piece in enumerate(pieces):
        dots = re.sub("%2e", ".", piece, flags=re.IGNORECASE)
        last = i == len(pieces) - 1
        if dots == "..":
            out = out[:-1]
        if dots in (".", ".."):
            out += [""] if last else []
        else:
            out.append(encoded(piece, _PATH_SET))
    return "/" + "/".join(out)


@lru_cache(maxsize=1 << 16)
def parse(text: str) -> Url | None:
    """An absolute address; None for a text that is none."""
    found = _SCHEME.fullmatch(re.sub("[\t\n\r]", "", text.strip(_BLANKS)))
    if not found:
        return None
    scheme, rest = found[1].lower(), found[2]
    special = scheme in PORTS
    cut = min([i for i in (rest.find("?"), rest.find("#")) if i >= 0], default=len(rest))
    rest = rest[:cut]
    slash = r"/\\" if special else "/"
    if scheme == "file":
        with_host = re.match(r"[/\\]{2}", rest)
    else:
        with_host = re.match(r"[/\\]*" if special else "//", rest)
    if not with_host:
        return Url(scheme, "", "", "", None, _path(rest, special) if special or rest.startswith("/") else encoded(rest, ""))
    rest = rest[with_host.end() :]
    end = re.search(f"[{slash}]", rest)
    authority, path = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    if scheme == "file":
        drive = _DRIVE.fullmatch(authority)
        host = "" if drive or not authority else host_of(authority, True)
        if host is None:
            return None
        return Url(scheme, "", "", "" if host == "localhost" else host, None, _path(("/" + authority if drive else "") + path, True))
    who, at, place = authority.rpartition("@")
    user, _, password = who.partition(":")
    name, colon, port = place, "", ""
    if ":" in place.rpartition("]")[2]:
        name, colon, port = place.rpartition(":")
    if port and not (port.isascii() and port.isdigit() and int(port) < 1 << 16):
        return None
    if not name and (special or at or colon):
        return None
    host = host_of(name, special) if name else ""
    if host is None:
        return None
    number = int(port) if port and int(port) != PORTS.get(scheme) else None
    return Url(scheme, encoded(user, _USER_SET), encoded(password, _USER_SET), host, number, _path(path, special))


def with_scheme(text: str) -> str:
    return text if "://" in text else f"https://{text}"


def bare(host: str) -> str:
    return host.lower().removeprefix("www.")


def domain(text: str) -> str | None:
    """the host of an address, without www., if it has a dot."""
    url = parse(with_scheme(text))
    name = bare(url.host) if url else ""
    return name if "." in name else None


def website(text: str) -> str | None:
    """an http(s) address without query, fragment, www. and last slash."""
    url = parse(with_scheme(text))
    if url is None or url.scheme not in ("http", "https"):
        return None
    name = bare(url.host)
    return url._replace(host=(host_of(name, True) if name else None) or url.host).without_query().removesuffix("/")

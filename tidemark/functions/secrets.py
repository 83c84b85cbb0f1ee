"""Texts without credentials (plain Python, driver side).

The text is seen through every layer of its percent-encoding at once: each layer is a view whose characters know which stretch of the source they
come from. Credentials are looked for in all views, by value (those the process holds) and by the name they are given; what is found is
cut out of the source itself. So text around a credential keeps its encoding, however deep the credential was wrapped.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

#: What stands in place of a credential, and in place of a text in which a held one is still found after cutting.
MASK, WITHHELD = "[redacted]", "[withheld: a credential could not be cut out]"
#: Held values shorter than this are not looked for: they would match ordinary words.
LEAST_SECRET = 6

# fixed values: the words that names of credentials are made of
VENDOR_PREFIXES = ("x", "apca")
QUALIFIERS = ("api", "access", "refresh", "auth", "client", "secret", "registration")
KINDS = ("key", "keyid", "token", "secret", "secretkey", "password", "passwd")
SCHEMES = ("bearer", "basic", "token")

_NAMES = {q + k for q in QUALIFIERS for k in KINDS} | {q + r + k for q in QUALIFIERS for r in QUALIFIERS for k in KINDS} | (set(KINDS) - {"key", "keyid"})
_NAME = re.compile(r"[A-Za-z][A-Za-z_-]*")
_GIVEN = re.compile(r"[\"']?\s*[:=]\s*")
_WORD = re.compile(r"[^\s&'\",;}\])]+")
_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


class View(NamedTuple):
    text: str
    #: Character k comes from source[begin[k]:end[k]].
    begin: list[int]
    end: list[int]


def _letters(raw: bytes) -> Iterator[tuple[str, int]]:
    """Characters of UTF-8 bytes, each with its number of bytes; a byte that begins none is U+FFFD."""
    at = 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                yield raw[at : at + size].decode(), size
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            yield "�", 1
        at += size


def _decoded(view: View) -> View:
    """One layer of percent-encoding less."""
    text, begin, end, at = [], [], [], 0
    for m in _ESCAPES.finditer(view.text):
        text.append(view.text[at : m.start()])
        begin += view.begin[at : m.start()]
        end += view.end[at : m.start()]
        at = m.start()
        for letter, size in _letters(bytes.fromhex(m[0].replace("%", ""))):
            text.append(letter)
            begin.append(view.begin[at])
            at += 3 * size
            end.append(view.end[at - 1])
    return View("".join([*text, view.text[at:]]), begin + view.begin[at:], end + view.end[at:])


def views(source: str) -> Iterator[View]:
    """The source, and what each further decoding gives, until nothing is left to decode (every layer is shorter)."""
    view = View(source, list(range(len(source))), list(range(1, len(source) + 1)))
    yield view
    while _ESCAPES.search(view.text):
        view = _decoded(view)
        yield view


def _is_credential(name: str) -> bool:
    plain = re.sub(r"[_-]", "", name.lower())
    return plain in _NAMES or any(plain.removeprefix(p) in _NAMES for p in (*VENDOR_PREFIXES, "".join(VENDOR_PREFIXES)) if plain.startswith(p))


def _named(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of values that stand after the name of a credential, after Authorization, after a scheme, or after a bare key of a query string."""
    for name in _NAME.finditer(text):
        word = name[0].lower()
        given = _GIVEN.match(text, name.end())
        in_query = word == "key" and text[name.start() - 1 : name.start()] in ("?", "&")
        if given and (in_query or word.endswith("authorization") or _is_credential(word)):
            at = given.end()
            quote = text[at : at + 1]
            if quote in ("'", '"') and (to := text.find(quote, at + 1)) > 0:
                yield at + 1, to
                continue
            value = _WORD.match(text, at)
            if value and value[0].lower() in SCHEMES and word.endswith("authorization"):
                value = _WORD.match(text, value.end() + 1)
            if value:
                yield value.span()
        elif word in SCHEMES[:2] and (value := re.compile(r"\s+([A-Za-z0-9._~+/=-]{8,})").match(text, name.end())):
            yield value.span(1)


def _held(text: str, secrets: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches that are a held value; a plus may stand for a space."""
    for secret in secrets:
        for m in re.finditer(f"(?={''.join('[ +]' if c == ' ' else re.escape(c) for c in secret)})", text):
            yield m.start(), m.start() + len(secret)


def redacted(text: object, secrets: Iterable[str] = ()) -> str:
    """text without credentials: the held secrets wherever they stand, and values given to names of credentials, at any depth of percent-encoding. None is an empty text."""
    source = "" if text is None else str(text)
    held = [s for s in secrets if s and len(s) >= LEAST_SECRET]
    cuts = sorted((v.begin[a], v.end[b - 1]) for v in views(source) for a, b in (*_held(v.text, held), *_named(v.text)) if b > a)
    out, at = [], 0
    for begin, end in cuts:
        if begin >= at:
            out += [source[at:begin], MASK]
        at = max(at, end)
    clean = "".join([*out, source[at:]])
    return WITHHELD if any(True for v in views(clean) for _ in _held(v.text, held)) else clean

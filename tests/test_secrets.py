"""Credentials are cut out at any depth of encoding; all else stays as it was."""

import random
from urllib.parse import quote, quote_plus, unquote, unquote_plus

import pytest

from tidemark.functions.secrets import MASK, WITHHELD, redacted

TOKEN = "pk_9fQ2zz81"


@pytest.mark.parametrize("form", [
    "https://data.test/v2/bars?apikey={}&limit=5", "https://data.test/obs?key={}", "x-api-key: {}", "'X-Api-Key': '{}'", '{{"APCA-API-SECRET-KEY": "{}"}}', "apca_api_key_id={}", "client-secret = {} # none", "Authorization: Bearer {}", "authorization={}",
    '"Authorization": "Basic {}"', "sent bearer {} to host", "registrationkey: {}, seriesid: 5", "password={};user=u", "refresh_token={}", "secretKey={})",
])
def test_named_values_go_at_any_depth(form):
    text = form.format(TOKEN)
    for depth in range(6):
        got = redacted(f"try 3: {text} (50%)")
        assert TOKEN not in got and MASK in got and got.startswith("try 3: ") and got.endswith("(50%)"), (depth, got)
        inner = got
        for _ in range(7):
            inner = unquote(inner)
        assert TOKEN not in inner
        text = quote(text, safe="")


def test_text_around_stays():
    for plain in ("monkey=5 keyed: 7 tokens: many sort_key=9 next_page_token=abcdefgh key=5 a%20b%2520c 100%", "the basic idea of bearers", "?keyword=x&monkey=y", "bearer of news"):
        assert redacted(plain) == plain
    assert redacted(None) == "" and redacted(17) == "17"
    assert redacted("a%20b?api_key=zzz9&c=%41") == f"a%20b?api_key={MASK}&c=%41"
    assert redacted("x%3Fapi_key%3Dzzz9%26c=%41") == f"x%3Fapi_key%3D{MASK}%26c=%41"
    assert redacted("%ff%fe é api_key=ö1ö2ö3 %e2%82%ac") == f"%ff%fe é api_key={MASK} %e2%82%ac"


def test_held_values_never_come_back():
    rng = random.Random(6)
    for _ in range(300):
        secret = "".join(rng.choice("ab/+ =%&é7") for _ in range(rng.randint(6, 14)))
        text, wraps = secret, rng.randint(0, 5)
        for _ in range(wraps):
            kind = rng.randrange(3)
            text = quote(text, safe="") if kind == 0 else quote_plus(text) if kind == 1 else "".join(f"%{b:02x}" if rng.random() < 0.5 else chr(b) if b < 128 else f"%{b:02X}" for b in text.encode()) if "%" not in text else quote(text, safe="")
        got = redacted(f"<<{text}>> and {text}.", [secret])
        seen = got
        for _ in range(8):
            assert secret not in seen and secret not in unquote_plus(seen)
            seen = unquote(seen)
        assert got == WITHHELD or got.startswith("<<") and got.endswith(".")
    assert redacted("short=abc", ["abc"]) == "short=abc" and redacted("abab" * 5, ["ababab"]) == MASK + ""

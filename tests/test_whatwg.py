"""Addresses: results that follow from the URL standard."""

import pytest

from coverlake.functions import text, whatwg

CASES = [
    ("HTTP://Example.ORG:80/a/../b/./c//d", "http://example.org/b/c//d"), ("https:example.org", "https://example.org/"), ("https:\\\\e.org\\x\\..\\y", "https://e.org/y"), ("http:///e.org", "http://e.org/"),
    ("https://e.org/%2e%2E/a/%2E", "https://e.org/a/"), ("https://e.org/a/..", "https://e.org/"), ("https://e.org/a b?c d'#e f", "https://e.org/a%20b?c%20d%27#e%20f"), ("https://e.org/é?ü=ö", "https://e.org/%C3%A9?%C3%BC=%C3%B6"),
    ("https://München.de/", "https://xn--mnchen-3ya.de/"), ("https://faß.de/", "https://xn--fa-hia.de/"), ("https://例え。テスト/", "https://xn--r8jz45g.xn--zckzah/"), ("https://EXAMPLE%2ecom", "https://example.com/"), ("https://ＧＯ.com", "https://go.com/"),
    ("http://0x7f.1/", "http://127.0.0.1/"), ("http://3232235777", "http://192.168.1.1/"), ("http://[2001:DB8:0:0::1]:8080/x", "http://[2001:db8::1]:8080/x"), ("http://[::ffff:1.2.3.4]", "http://[::ffff:102:304]/"), ("https://u:p@ss@e.org:443/", "https://u:p%40ss@e.org/"),
    ("  \thttps://e.org/a\n/b  ", "https://e.org/a/b"), ("mailto:a b@c", "mailto:a b@c"), ("data:text/plain,é", "data:text/plain,%C3%A9"), ("foo://H/../x", "foo://H/x"), ("https://e.org/?", "https://e.org/?"), ("https://e.org/{a}^`|", "https://e.org/%7Ba%7D%5E%60|"), ("file:///a/../b", "file:///b"), ("ftp://e.org:21/x", "ftp://e.org/x"),
]


@pytest.mark.parametrize("given,want", CASES)
def test_parse(given, want):
    assert str(whatwg.parse(given)) == want
    assert str(whatwg.parse(want)) == want  # what is written is read alike


@pytest.mark.parametrize(
    "given",
    [
        "", "e.org", "//e.org", "https://", "https://a b/", "https://e.org:99999/", "https://1.2.3.256", "https://1.2.3.4.5",
        "https://[::1", "https://a<b", "http://a%00b", "https://user@/x", "http://0xg.1.1.0x"
    ]
)
def test_no_address(given):
    if given == "http://0xg.1.1.0x":  # the last part is a number, the first none
        with pytest.raises(ValueError):
            whatwg.parse(given)
        return
    with pytest.raises(ValueError):
        whatwg.parse(given)


def test_clean():
    cases = {
        "https://E.org/a/../b/?utm_source=x&B=2&a=1&amp;fbclid=z#top": "https://e.org/b?a=1&B=2", "https://e.org/x?a=~&a=*&a=%20": "https://e.org/x?a=+&a=*&a=%7E", "https://e.org/?utm_id=1": "https://e.org/", "not an address/": "not an address",
        "https://www.bing.com/news/apiclick.aspx?ref=x&url=https%3a%2f%2fe.org%2fa%2f..%2fb%3futm_source%3dq&c=1": "https://e.org/b", "https://e.org/a//": "https://e.org/a", None: "", "": "", "https://e.org/x?b&a=2&a=1&A=0": "https://e.org/x?a=1&a=2&A=0&b=",
    }
    assert {k: text.clean_url(k) for k in cases} == cases


def test_plain_parts_are_passed_on_as_they_are():
    """The short ways give what the long ones give, and take them: a character is not looked at one by one."""
    import random

    rng = random.Random(3)
    for chosen in (whatwg.FRAGMENT, whatwg.QUERY, whatwg.SPECIAL_QUERY, whatwg.PATH, whatwg.USERINFO, ""):
        for _ in range(300):
            t = "".join(rng.choice("ab9/ ~^]\\[-'\"`?#<>\x7f\x01é日") for _ in range(rng.randint(0, 6)))
            want = "".join(c if " " <= c <= "~" and c not in chosen else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in t)
            assert whatwg.encoded(t, chosen) == want
    plain = "/view/123"
    assert whatwg.encoded(plain, whatwg.PATH) is plain
    assert whatwg.domain("SRC1.Example.COM") == "src1.example.com"
    assert whatwg.written([("a.b", "c d"), ("é", "")]) == "a.b=c+d&%C3%A9="

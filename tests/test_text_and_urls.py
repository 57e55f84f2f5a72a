"""Column functions against plain-Python twins and examples."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from chronofact.functions import numbers as n
from chronofact.functions import text as t
from chronofact.functions import urls as u


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_names(spark):
    values = ["OpenAI", " GPT-4o. ", "Été à_la", "", None, "a b", "x²"]
    assert column(spark, values, t.normalise_name) == ["openai", "gpt 4o", "été à_la", "", None, "a b", "x²"]


def test_names_against_python(spark):
    rng = random.Random(0)
    values = ["".join(rng.choices("aB1_ -.é\n,ß$", k=12)) for _ in range(200)]
    assert column(spark, values, t.normalise_name) == [re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", v.lower())).strip() for v in values]


def test_content_and_lists(spark):
    assert column(spark, [" a \n b ", None], lambda c: t.normalized_content(F.lit(" T  x "), c)) == ["T x\n\na b", "T x"]
    assert column(spark, [[" É", unicodedata.normalize("NFD", "É"), "", None, "b"], None], t.normalize_authors, "array<string>") == [["É", "b"], None]
    assert column(spark, [["Straße", "STRASSE", " x"]], t.normalize_tags, "array<string>") == [["strasse", "x"]]


def test_dates(spark):
    got = column(spark, ["Tue, 02 Jan 2024 10:00:00 +0200", "2 Jan 2024 10:00:00 GMT", "02 Jan 2024 10:00:00", "soon", None], t.parse_pub_date)
    assert [x and x.isoformat() for x in got] == ["2024-01-02T08:00:00", "2024-01-02T10:00:00", "2024-01-02T10:00:00", None, None]
    assert column(spark, ["soon", None, "2 Jan 2024 10:00:00 GMT"], t.bad_pub_date) == [True, False, False]


def test_values(spark):
    assert column(spark, ["100K", "1.5m", "100,000", "0", "-1", "1.5", "true", "1.0001K", None], t.context_value) == ["100000", "1500000", "100000", None, None, None, None, None, None]
    assert [x and float(x) for x in column(spark, ["$1,234.56", "5", "$$5", "1,23", "5 USD"], t.parse_price)] == [1234.56, 5.0, None, None, None]
    assert [x and int(x) for x in column(spark, ["12", "-3", "1.5", "", "x"], t.parse_int)] == [12, -3, None, None, None]
    assert column(spark, ["5d", "1_000", "1e3", ".5", "nan"], t.as_number) == [None, None, 1000.0, 0.5, None]
    assert column(spark, ["context_window_tokens", "licence_terms", "other_field"], t.field_label) == ["context window", "licence terms", "other field"]


def brute_numbers(text):
    """The definitions: matches that lie in no name and, for plain numbers, in no multiplied number."""
    number, name, multiplied = (re.compile(p) for p in (r"(?<![A-Za-z])\d+(?:\.\d+)?(?![A-Za-z])", r"[A-Za-z]+-\d+(?:\.\d+)?[A-Za-z]*", r"(?<![A-Za-z])(\d+(?:\.\d+)?)\s*([kKmM])(?![A-Za-z])"))
    plain = re.sub(r"[,$%]", "", text)

    def outside(m, *patterns):
        return not any(s.start() <= m.start() and m.end() <= s.end() for p in patterns for s in p.finditer(plain))

    written = {float(m[1]) * (1e3 if m[2] in "kK" else 1e6) for m in multiplied.finditer(plain) if outside(m, name)}
    return sorted({m[0] for m in number.finditer(plain) if outside(m, name, multiplied)}), sorted(written)


def test_numbers(spark):
    rng = random.Random(1)
    texts = ["$256,000 and 256000, GPT-4.5, o1 5%", "100K or 1.5 m, GPT-4k", "100K tokens", "5 k-8", "a-5 K", "a-1.5 M", "1.2.33K", "77a-8", "55x", "", None]
    texts += ["".join(rng.choices("a1K.-, 5m$o", k=rng.randint(0, 14))) for _ in range(20000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", n.numbers_in(F.col("t")).alias("p"), n.multiplier_numbers(F.col("t")).alias("m")).collect()
    for r in rows:
        t = texts[r["i"]]
        got = (r["p"], r["m"] if r["m"] is None else sorted(map(float, r["m"])))
        assert got == ((None, None) if t is None else brute_numbers(t)), t
    assert [rows[i]["m"] for i in range(3)] == [[], ["100000", "1500000"], ["100000"]] and rows[0]["p"] == ["256000", "5"]
    assert column(spark, ["5 and 6K", "0.0015K", None, ""], n.all_numbers) == [["5", "6000"], ["1.5"], None, []]


def test_canonical_urls(spark):
    urls = ["HTTPS://Example.COM:443/a//?b=2&a=&utm_x=1&ref=z#f", "http://x.org:80", "http://x.org/", "https://u:p@x.org/", "ftp://x.org/", "https://x.org:99999/", "", None, "https://x.org/a%20b?q=a+b~*", "https://x.org:8443/a/"]
    got = column(spark, urls, u.canonical_url)
    assert [r["url"] if r else None for r in got] == ["https://example.com/a?a=&b=2", "http://x.org", "http://x.org/", None, None, None, None, None, "https://x.org/a%20b?q=a+b~%2A", "https://x.org:8443/a"]
    assert [r["reason"] for r in got][3:6] == ["user-info in url", "not an absolute http(s) url", "malformed url"]


def test_url_rules(spark):
    assert column(spark, ["https://a.org/p?q#f", "http://[bad", "urn:x", "https://u@a.org:1/p", None], u.sanitize_url) == ["https://a.org/p", "<unparsable-url>", "urn:x", "https://a.org:1/p", None]
    hosts = F.array(F.lit("A.org"))
    assert column(spark, ["https://a.org/", "http://a.org/", "https://u@a.org/", "https://b.org/", "https://a.org:99999/"], lambda c: u.unsafe_reason(c, hosts)) == [None, "scheme is not https", "user-info in url", "host not on the allowlist", "unparseable url"]
    assert column(spark, ["10.1.2.3", "2001:db8:1:2ff::1", "x", None], u.network_identity) == ["10.1.2.0/24", "2001:db8:1:200::/56", None, None]


def test_plain_urls_need_no_python(spark):
    """Urls of every form against Python's own parser, and addresses against its networks."""
    import ipaddress
    from urllib.parse import urlsplit, urlunsplit

    rng = random.Random(7)
    made = ["".join(rng.choices(["http", "https", "HTTP", "://", "a.org", "B.Org", ":80", ":065", ":99999", ":", "/", "/p//q", "?x=1", "#f", "@", "u:p", "[::1]", "é", " ", "\t", "%20", "a_b"], k=rng.randint(1, 7))) for _ in range(3000)]
    made += ["https://" + u for u in made[:1500]] + ["https://a.org" + u for u in made[:500]]

    def plain(u):
        try:
            parts = urlsplit(u)
            port = parts.port
        except ValueError:
            return "<unparsable-url>", None
        host = parts.hostname or ""
        shown = u if not parts.scheme and not host else urlunsplit((parts.scheme, host + ("" if port is None else f":{port}"), parts.path, "", ""))
        return shown, (parts.scheme, host.lower() or None, bool(parts.username or parts.password))

    got = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, t string").select("i", u.sanitize_url("t").alias("s"), u.url_safety_parts("t").alias("p")).collect()
    for r in got:
        shown, parts = plain(made[r["i"]])
        assert r["s"] == shown and (tuple(r["p"])[:3] == parts if parts else not r["p"]["ok"]), made[r["i"]]
    ips = ["10.1.2.3", "010.1.2.3", "256.1.1.1", "1.2.3", "::1", "2001:db8::1%eth0", "2001:db8:1:2ff::9", "::ffff:1.2.3.4", "1.2.3.4 ", "", None, "x:y"]

    def network(a):
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            return None
        try:
            return str(ipaddress.ip_network((a, 24 if ip.version == 4 else 56), strict=False))
        except ValueError:
            return None

    assert column(spark, ips, u.network_identity) == [network(a) if a is not None else None for a in ips]

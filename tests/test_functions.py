"""Vectors for the scalar rules."""

import random

import pytest
from pyspark.sql import functions as F

from creativeaudit import constants as C
from creativeaudit.functions import media, net, numbering, rounding, text, verdict


def column(spark, values, type_="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")


def evaluate(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_slugify(spark):
    cases = {"Garden tools": "garden_tools", "Loud colours": "loud_colours",
             "  Salt & Sour Sweets!! ": "salt_sour_sweets", "Garden_Tools": "garden_tools",
             "7Up cans": "up_cans", "123": "", "": "", "Straße": "strasse", "ﬁsh": "fish",
             "\tTabs ": "tabs", "ſalt": "salt", "STRAẞE": "strasse"}
    df = column(spark, list(cases))
    assert evaluate(df, text.slugify(F.col("v"))) == list(cases.values())


def test_is_slug(spark):
    bad = ["9leading_digit", "has-a-hyphen", "has space", "", "line\n"]
    df = column(spark, ["alcohol", "a_1"] + bad)
    assert evaluate(df, text.is_slug(F.col("v"))) == [True, True] + [False] * len(bad)


def test_normalise_tags(spark):
    df = column(spark, ["alcohol, vaping ,, alcohol", "", "   ,  ", None])
    assert evaluate(df, text.tags_from_csv(F.col("v"))) == [["alcohol", "vaping"], [], [], None]
    df = column(spark, [["b", "a", "b"], []], "array<string>")
    assert evaluate(df, text.clean_tags(F.col("v"))) == [["b", "a"], []]


@pytest.mark.parametrize("hops,header,want", [
    (1, "F, R", "R"), (2, "F, R, 10.9.9.9", "R"), (5, "F, R", "F"), (1, "  F ,  R  , ", "R"),
    (1, None, "peer"), (1, "", "peer"), (0, "F, R", "peer")])
def test_client_identity(spark, hops, header, want):
    df = spark.createDataFrame([("peer", header)], "p string, h string")
    assert df.select(text.client_identity(F.col("p"), F.col("h"), hops)).first()[0] == want


def test_addresses(spark):
    refused = ["127.0.0.1", "::1", "169.254.169.254", "10.0.0.1", "172.16.0.5", "192.168.1.1", "100.64.0.1",
               "0.0.0.0", "224.0.0.1", "fd00::1", "fe80::1", "::ffff:127.0.0.1", "::ffff:169.254.169.254",
               "not-an-ip", "::", "1.2.3", "256.1.1.1", "01.2.3.4", "1::2::3", "12345::", "2001:db8::1", "ff02::1",
               "fe80::1%eth0", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "192.0.2.7", "255.255.255.255"]
    allowed = ["93.184.216.34", "8.8.8.8", "2606:2800:220:1:248:1893:25c8:1946", "::ffff:8.8.8.8",
               "2606:4700:4700::1111", "192.0.0.9", "172.32.0.1"]
    df = column(spark, refused + allowed)
    assert evaluate(df, net.is_public_address(F.col("v"))) == [False] * len(refused) + [True] * len(allowed)


def test_addresses_against_the_standard_library(spark):
    import ipaddress

    rng = random.Random(5)
    v4 = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    v6 = [str(ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), (0x2001 << 112) | rng.getrandbits(112) >> rng.choice([0, 40, 100]),
                                                rng.getrandbits(120)]))) for _ in range(300)]

    def public(a):
        ip = ipaddress.ip_address(a)
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved
                    or ip.is_unspecified or (ip.version == 4 and ip in ipaddress.ip_network("100.64.0.0/10")))

    df = column(spark, v4 + v6)
    got = evaluate(df, net.is_public_address(F.col("v")))
    assert [a for a, g in zip(v4 + v6, got) if g != public(a)] == []


def test_urls(spark):
    cases = {"file:///etc/passwd": False, "gopher://x/": False, "ftp://x/": False, "HTTPS://8.8.8.8/a": True, "https://example.com/a": False,
             "http://": False, "http://user:pw@10.0.0.1/": False, "http://[::1]:80/": False, "http://2130706433/": False,
             "http://0x7f000001/": False, "http://9.9.9.9:8080/x?y#z": True, "example.com": False, "http://localhost/": False, "http://127.0.0.1./": False,
             "http://0x7f.0.0.1/": False, "http://0177.0.0.1/": False,
             "http://[2606:4700:4700::1111]/": True}
    df = column(spark, list(cases))
    assert evaluate(df, net.url_allowed(F.col("v"))) == list(cases.values())


def test_every_address_must_be_public(spark):
    public = ["8.8.8.8"]
    cases = [("http://a.example", ["8.8.8.8", "10.0.0.1"], False), ("http://a.example", public, True), ("http://a.example", [], False),
             ("http://a.example", None, False), ("http://a.example.", public, True), ("http://0x7f.0.0.1/", public, False),
             ("http://127.0.0.1./", public, False), ("http://a.example", [None], False)]
    df = spark.createDataFrame(cases, "u string, a array<string>, ok boolean")
    assert [r[0] for r in df.select(net.url_allowed(F.col("u"), F.col("a"))).collect()] == [c[2] for c in cases]


def test_magic_bytes(spark):
    cases = [(b"\xff\xd8\xff\xe0", "image", "image/jpeg"), (b"\x89PNG\r\n\x1a\n", "image", "image/png"),
             (b"GIF87a..", "image", "image/gif"), (b"GIF89a..", "image", "image/gif"),
             (b"RIFF\x00\x00\x00\x00WEBPVP8", "image", "image/webp"), (b"\x1aE\xdf\xa3", "video", None),
             (b"\x00\x00\x00\x20ftypisom", "video", None), (b"plain text", "image", None), (b"", "image", None),
             (b"RIFF\x00\x00\x00\x00WAVE", "image", None)]
    df = column(spark, [bytearray(c[0]) for c in cases], "binary")
    assert evaluate(df, media.media_kind(F.col("v"))) == [c[1] for c in cases]
    kinds = F.when(media.media_kind(F.col("v")) == "image", media.image_mime(F.col("v")))
    assert evaluate(df, kinds) == [c[2] for c in cases]


def test_intake_bounds_are_strict(spark):
    rows = [("image", 0, None, None, "INVALID_IMAGE"), ("image", C.MAX_IMAGE_BYTES, None, None, None),
            ("image", C.MAX_IMAGE_BYTES + 1, None, None, "IMAGE_TOO_LARGE"), ("video", C.MAX_VIDEO_BYTES, 60.0, 1, None),
            ("video", C.MAX_VIDEO_BYTES + 1, 99.0, 1, "VIDEO_TOO_LARGE"), ("video", 5, 60.01, 0, "VIDEO_TOO_LONG"),
            ("video", 5, 0.0, 0, "INVALID_VIDEO"), ("video", 5, None, 3, None), ("image", C.MAX_IMAGE_BYTES * 2, 90.0, 0, "IMAGE_TOO_LARGE")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, n bigint, d double, f int, want string")
    got = evaluate(df, media.reject_code(F.col("k"), F.col("n"), F.col("d"), F.col("f")))
    assert got == [r[-1] for r in rows]


def test_confidence_and_band(spark):
    rows = [(True, .95, "high", "present"), (True, .85, "high", "present"), (True, .70, "medium", "present"),
            (False, .60, "medium", "absent"), (True, .30, "low", "present"), (None, .99, "low", "uncertain")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p boolean, s double, c string, b string")
    assert evaluate(df, verdict.confidence(F.col("p"), F.col("s"))) == [r[2] for r in rows]
    assert evaluate(df, verdict.band(F.col("p"))) == [r[3] for r in rows]


def test_effective_calibrated(spark):
    rows = [(True, "v1", "v2", False), (True, "v2", "v2", True), (False, "v2", "v2", False), (None, None, "v2", False),
            (True, "v1", None, True), (True, "v1", "", True), (True, None, "v2", True), (True, "", "v2", True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c boolean, s string, l string, w boolean")
    assert evaluate(df, verdict.effective_calibrated(F.col("c"), F.col("s"), F.col("l"))) == [r[3] for r in rows]


def test_rates_round_exact_halves_to_even(spark):
    values = sorted({k / n for n in range(1, 400) for k in range(n + 1)})
    df = column(spark, values, "double")
    for digits in (3, 4):
        assert evaluate(df, rounding.round_rate(F.col("v"), digits)) == [round(v, digits) for v in values]
    assert (round(3 / 80, 3), round(3 / 160, 4)) == (0.037, 0.0187)


def test_running_equals_plain_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.randrange(10_000_000), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, us bigint, id int, amount bigint").withColumn("ts", F.timestamp_micros("us"))
    got = numbering.running(df, ["k"], [F.col("ts"), F.col("id")], numbering.floor_seconds(F.col("ts"), 1),
                            amount=F.col("amount"), name="run", total="all")
    want, sums = {}, {}
    for k, us, i, a in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        sums[k] = sums.get(k, 0) + a
        want[i] = (k, sums[k])
    for r in got.collect():
        assert want[r["id"]] == (r["k"], r["run"]) and r["all"] == sums[r["k"]]

"""Facts about single functions."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions import geometry as g
from pageloom.functions import metrics as m
from pageloom.functions import text as t


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def box(*sides):
    return g.box(*map(F.lit, map(float, sides)))


def rect(*sides):
    return g.rect(*map(F.lit, map(float, sides)))


def test_boxes(spark):
    a, b = box(0, 0, 10, 10), box(0, 0, 10, 9)
    assert one(spark, g.iou(a, b), g.iom(a, b), g.area_ratio(a, b)) == [0.9, 1.0, 0.9]
    assert one(spark, g.intersection(a, box(10, 0, 20, 10)), g.iou(box(1, 1, 1, 1), a), g.area(box(5, 20, 0, 0))) == [0.0, 0.0, 100.0]


def test_rectangles(spark):
    assert list(one(spark, g.to_rect(box(1, 2, 3, 5), F.lit(100.0)))[0]) == [1.0, 95.0, 3.0, 98.0]
    assert list(one(spark, g.render_rect(rect(0, 0, 100, 30), F.lit(12.0)))[0]) == [0.0, 0.0, 100.0, 30.0]
    grown = one(spark, g.render_rect(rect(0, 0, 100, 30), F.lit(20.0)))[0]
    assert list(grown) == pytest.approx([-4.0, -5.4, 104.0, 48.0])
    assert one(spark, g.same_column(rect(0, 0, 100, 10), rect(5, 20, 95, 30)), g.same_column(rect(0, 0, 100, 10), rect(300, 0, 400, 10))) == [True, False]


def test_metrics(spark):
    text, font = F.lit("Hello"), F.lit(10.0)
    lines = m.line_count(text, F.lit(12.0), font)
    assert one(spark, lines, m.line_height(F.lit(12.0), font, F.lit(1)), m.letter_spacing(text, F.lit(30.0), font, F.lit(1))) == [1, 12.0, 0.05]
    none = F.lit(None).cast("double")
    assert one(spark, m.line_count(F.lit("a\n\nb"), F.lit(50.0), none), m.line_height(F.lit(1.0), none, F.lit(1)), m.combined_spacing(F.lit(-0.2), F.lit(-0.1)), m.combined_spacing(none, F.lit(0.004))) == [2, None, -0.22, None]
    assert one(spark, m.line_count(F.lit("x" * 90), F.lit(5.0), font)) == [2]


def test_texts(spark):
    said = [t.slug(F.lit("  My File (1).PDF ")), t.slug(F.lit("한국")), t.normalised(F.lit(" A  b\n")), t.stage(F.lit("Rendering translated PDF")), t.stage(F.lit("Rendering")), t.stage(F.lit("Done"))]
    assert one(spark, *said) == ["my-file-1-pdf", "document", "a b", "translating", "rendering", "parsing"]
    assert one(spark, t.without_repeats(F.lit("a a a a a a a a")), t.without_repeats(F.lit("하나" * 7)), t.without_repeats(F.lit("-" * 12 + " ok"))) == ["a", "하나", "- ok"]
    assert one(spark, t.font_family(F.lit("A!b")), t.font_family(F.lit("")), t.font_family(F.lit("x"), "Noto")) == ["Ab", "sans-serif", "Noto"]
    html = one(spark, t.html_block(F.lit("a<b\nc"), F.lit("Noto"), F.lit(10.0), F.lit(12.0), F.lit(None).cast("double")))[0]
    assert "a&lt;b<br/>c" in html and "letter-spacing" not in html


@pytest.mark.parametrize(("ip", "held"), [("127.0.0.1", False), ("::1", False), ("localhost", False), ("", False), ("192.168.0.10", True)])
def test_loopback_is_free(spark, ip, held):
    assert one(spark, t.limited(F.lit(ip))) == [held]


def test_addresses(spark):
    fwd = F.lit(" 10.0.0.1 , 8.8.8.8")
    assert one(spark, t.client_ip(fwd, F.lit(""), F.lit("p")), t.client_ip(fwd, F.lit(""), F.lit("p"), public_only=True), t.client_ip(F.lit(None).cast("string"), F.lit(" "), F.lit("p"))) == ["10.0.0.1", "8.8.8.8", "p"]


def test_addresses_equal_the_standard_library(spark):
    rng = random.Random(4)
    said = ["", "127.evil", "::ffff:127.0.0.1", "0:0:0:0:0:0:0:1", "::1", "2001:4860:4860::8888", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "::", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "12345::", "g::1", "fe80::1%eth0", "64:ff9b:1::9", "2002::1", "100.64.0.1", "224.0.0.1", "192.0.0.9", "2001:20::1", "::1.2.3.4", "::ffff:8.8.8.8", "1:2:3:4:5:6:1.2.3.4"]
    said += [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(200)]
    said += [str(ipaddress.IPv6Address(rng.choice([0x2001, 0xFC00, 0xFE80, 0x2002, 0x2A00, 0]) << 112 | rng.getrandbits(rng.choice([16, 32, 112])))) for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in said], "x string").select("x", t.public_ip(F.col("x")).alias("p"), t.loopback(F.col("x")).alias("l")).collect()

    def plain(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return False, False
        a = getattr(a, "ipv4_mapped", None) or a
        return a.is_global, a.is_loopback

    assert {r["x"]: (r["p"], r["l"]) for r in got} == {x: plain(x) for x in said}


def test_glossary_replaces_in_order(spark):
    gl = spark.createDataFrame([(1, "Comments", "X"), (2, "Comment", "Y")], "ord int, src string, dst string")
    df = spark.createDataFrame([("Comments  and Comment",)], "text string")
    assert t.with_glossary(df, "text", gl, "said").first()["said"] == "X and Y"

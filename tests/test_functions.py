import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.fields import CORE_FIELDS, SPLIT_COLUMNS, TERM_CATEGORIES, TERMS
from driftline.functions import geometry, numbers, text
from driftline.functions.hashing import dataset_bucket, record_bucket, split_of_bucket
from driftline.functions.pvalues import (
    _chi2_tail, _exact_ks_tail, chi2_tail, exact_ks_tail, kolmogorov_tail,
)


def test_field_lists():
    assert len(TERMS) == len(set(TERMS)) == 188
    assert len(TERM_CATEGORIES) == 12
    assert len(CORE_FIELDS) == 15
    assert len(SPLIT_COLUMNS) == 13


def test_buckets_match_hashlib(spark):
    ids = [f"id-{i}" for i in range(2000)] + ["", "ü", "漢字"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select(
        "id", dataset_bucket(F.col("id")).alias("d"), record_bucket(F.col("id")).alias("r"),
        split_of_bucket(F.col("r")).alias("s"),
    ).collect()
    for row in rows:
        digest = hashlib.sha256(row["id"].encode()).hexdigest()
        assert row["d"] == int(digest, 16) % 100
        assert row["r"] == int(digest[:16], 16) % 100
        assert row["s"] == ("train" if row["r"] < 80 else "dev" if row["r"] < 90 else "test")


def test_null_id_has_no_split(spark):
    row = spark.range(1).select(
        split_of_bucket(record_bucket(F.lit(None).cast("string"))).alias("s")
    ).first()
    assert row["s"] is None


BLANKS = ["", " ", "\t", "\n", "\u00a0", "\u3000", "\u2003 \t", None]


def test_blank_handling(spark):
    values = [(v,) for v in BLANKS + [" a ", "\u00a0x\u3000", "0"]]
    rows = spark.createDataFrame(values, "v string").select(
        "v", text.has_text(F.col("v")).alias("has"), text.trimmed_or_null(F.col("v")).alias("t")
    ).collect()
    for row in rows:
        expected = row["v"].strip() if row["v"] is not None else ""
        assert row["has"] == bool(expected)
        assert row["t"] == (expected or None)


# value, loose, strict, real
URLS = [
    ("https://dx.doi.org/10.17504/abc.v2", True, True, True),
    ("HTTP://EXAMPLE.ORG", True, True, True),
    ("www.example.org/a?b=c#d", True, False, False),
    ("doi:10.1007/s00300-011-1100-4", True, False, True),
    ("Pel.Trawl", True, False, False),
    ("BC-0.25", True, False, False),
    ("DN:I.DEN.(1.4)", True, False, False),
    ("5.7mm", True, False, False),
    ("gps", False, False, False),
    ("see https://example.org", False, False, False),
    ("https://example.org/a b", False, False, False),
    ("", False, False, False),
    (None, False, False, False),
]


def test_url_patterns(spark):
    rows = spark.createDataFrame([(u[0],) for u in URLS], "v string").select(
        text.is_loose_url(F.col("v")), text.is_strict_url(F.col("v")), text.is_real_url(F.col("v"))
    ).collect()
    assert [tuple(r) for r in rows] == [u[1:] for u in URLS]


def test_html_to_text(spark):
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><script>var a='</p>';</script>"
        "<nav>menu</nav><!-- note --><div class=\"ad\">buy</div><h1>Title&amp;more</h1>"
        "<p>One <b>two</b><br>three &lt;4&gt;</p><nav>open</body></html>"
    )
    cases = [(page, "Title&more\nOne two\nthree <4>\nopen"), ("<p> </p>", None),
             ("a<script>never closed", "a"), (None, None)]
    rows = spark.createDataFrame([(c[0],) for c in cases], "h string").select(
        text.html_to_text(F.col("h"))
    ).collect()
    assert [r[0] for r in rows] == [c[1] for c in cases]


PAGE_TEXTS = [
    ("plain", "plain"), ("", None), (" \n\t ", None), ("<p>a</p><p>b</p>", "a\nb"), ("a<br/>b<BR>c", "a\nb\nc"),
    ("<div>x<div>y</div></div>", "x\ny"), ("<ul><li>1<li>2</ul>", "1\n2"), ("<h2>T</h2>text", "T\ntext"),
    ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "ab\nc"), ("a&nbsp;&nbsp;b", "a b"),
    ("&lt;p&gt; &quot;q&quot; &#39;r&apos;", "<p> \"q\" 'r'"), ("&amp;lt;", "&lt;"), ("a <!-- b --> c <!-- d", "a c"),
    ("<style>p{}</style>s<STYLE>x", "s"), ("<header>h</header>m<footer>f</footer>", "m"), ("<aside>x</aside>y<aside>z", "yz"),
    ('<div class="ad top">no</div>yes<div class="add">no</div>', "yes"), ("<b>bo</b>ld", "bold"),
    ("one  two\t\tthree\r\nfour", "one two three\nfour"), ("<p>\n  in\n\n  lines </p>", "in\nlines"), ("a < b and c > d", "a d"),
    ("<head><title>t</title></head><body>b", "b"), ("<prose>x</prose>", "x"), ("é<p>ß</p>", "é\nß"),
]


def test_page_texts_in_both_engines(spark):
    """Known texts, from the chain of expressions and from the SQL that checks it."""
    import duckdb
    import pandas as pd

    from driftline.plans.oracle import html_text

    expected = [t for _, t in PAGE_TEXTS]
    frame = pd.DataFrame({"i": range(len(PAGE_TEXTS)), "h": [h for h, _ in PAGE_TEXTS]})  # noqa: F841 (read by name)
    sql = duckdb.sql(f"select {html_text('h')} from frame order by i").fetchall()
    rows = spark.createDataFrame(list(enumerate(h for h, _ in PAGE_TEXTS)), "i int, h string").orderBy("i").select(
        text.html_to_text(F.col("h"))
    ).collect()
    assert [r[0] for r in rows] == expected
    assert [r[0] for r in sql] == expected


def test_rounding_and_percent(spark):
    row = spark.range(1).select(
        numbers.round_half_away(F.lit(12.25), 1), numbers.round_half_away(F.lit(-12.25), 1),
        numbers.round_half_away(F.lit(0.0), 1), numbers.percent(F.lit(1), F.lit(8)),
        numbers.percent(F.lit(1), F.lit(0)), numbers.text_bar(F.lit(52.0)),
        numbers.is_finite(F.lit(float("nan"))), numbers.is_finite(F.lit(float("-inf"))),
    ).first()
    assert tuple(row) == (12.3, -12.3, 0.0, 12.5, 0.0, "█" * 10 + "░" * 10, False, False)


def test_hex_cells_match_nearest_centre(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(500)]
    points += [(-180.0, -90.0), (180.0, 90.0), (0.0, 0.0)]
    df = spark.createDataFrame(points, "lon double, lat double")
    hx, hy = geometry.hex_cell(F.col("lon"), F.col("lat"))
    rows = df.select("lon", "lat", hx.alias("hx"), hy.alias("hy")).collect()
    cells = [(i, j) for i in range(0, 161) for j in range(0, 93) if i % 2 == j % 2]
    cx = np.array([c[0] / 2 for c in cells])
    cy = np.array([c[1] / 2 for c in cells])
    for r in rows:
        x, y = (r["lon"] + 180) / 4.5, (r["lat"] + 90) / (180 / 46)
        dist = (x - cx) ** 2 + 3 * (y - cy) ** 2
        k = cells.index((r["hx"], r["hy"]))
        assert dist[k] <= dist.min() + 1e-6


def test_tiles(spark):
    rng = random.Random(2)
    points = [(rng.uniform(-180, 180), rng.uniform(-85, 85)) for _ in range(300)]
    points += [(180.0, 0.0), (-180.0, 90.0), (0.0, -90.0)]
    df = spark.createDataFrame(points, "lon double, lat double")
    for zoom in (0, 5, 12):
        rows = df.select("lon", "lat", geometry.tile_x(F.col("lon"), zoom).alias("x"),
                         geometry.tile_y(F.col("lat"), zoom).alias("y")).collect()
        for r in rows:
            n = 2**zoom
            lat = math.radians(max(-85.0511287798066, min(85.0511287798066, r["lat"])))
            x = min(n - 1, max(0, math.floor((r["lon"] + 180) / 360 * n)))
            y = min(n - 1, max(0, math.floor((1 - math.asinh(math.tan(lat)) / math.pi) / 2 * n)))
            assert (r["x"], r["y"]) == (x, y)


def _brute_ks_tail(d, n, m):
    """Share of all orders of n a's and m b's whose largest gap is at least d."""
    from itertools import combinations

    hits = total = 0
    for places in combinations(range(n + m), n):
        chosen, i, gap = set(places), 0, 0.0
        for k in range(n + m):
            i += k in chosen
            gap = max(gap, abs(i / n - (k + 1 - i) / m))
        hits += gap >= d - 1e-12
        total += 1
    return hits / total


@pytest.mark.parametrize("n,m", [(5, 5), (4, 7), (6, 9), (3, 10)])
def test_exact_ks_tail(n, m):
    for num in range(1, n * m + 1, 5):
        d = num / (n * m)
        g = math.lcm(n, m)
        d = round(d * g) / g
        assert _exact_ks_tail(d, n, m) == pytest.approx(_brute_ks_tail(d, n, m), abs=1e-12)


def test_ks_series_close_to_exact(spark):
    cases = [(0.02, 5000, 8000), (0.03, 3000, 9000), (0.05, 900, 1000), (0.001, 500, 600)]
    rows = spark.createDataFrame(cases, "d double, n long, m long").select(
        "d", "n", "m", kolmogorov_tail(F.col("d"), F.col("n"), F.col("m")).alias("series"),
        exact_ks_tail("d", "n", "m").alias("exact"),
    ).collect()
    for r in rows:
        assert r["series"] == pytest.approx(r["exact"], abs=0.01)
    large, none = spark.createDataFrame([(1.0, 20000, 5), (None, 20000, 0)], "d double, n long, m long").select(
        exact_ks_tail("d", "n", "m")
    ).collect()
    assert 0 <= large[0] < 1e-12 and none[0] is None


@pytest.mark.parametrize("x,dof,p", [
    (3.841458820694124, 1, 0.05), (7.814727903251179, 3, 0.05), (11.070497693516351, 5, 0.05),
    (66.33864886296881, 49, 0.05), (9.487729036781154, 4, 0.05), (0.0, 3, 1.0),
])
def test_chi2_tail(x, dof, p):
    assert _chi2_tail(x, dof) == pytest.approx(p, abs=1e-10)


def test_chi2_tail_column(spark):
    df = spark.createDataFrame([(3.841458820694124, 1), (None, 2)], "x double, dof int")
    values = [r[0] for r in df.select(chi2_tail("x", "dof")).collect()]
    assert values[0] == pytest.approx(0.05) and values[1] is None

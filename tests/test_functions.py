"""Hand tables for the value rules (falsy values, dates, text, e-mails, scores).
Expected values are written out by hand from the rules."""

from pyspark.sql import functions as F

from postwise.functions import predicates as P
from postwise.functions import scoring as S
from postwise.functions import text as T
from postwise.functions import values as V


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_first_truthy_treats_empty_as_missing(spark):
    df = spark.createDataFrame([("", None, "c"), (None, "b", "c"), ("", "", "")], "a string, b string, c string")
    got = [r[0] for r in df.select(V.first_truthy("a", "b", "c", default="d")).collect()]
    assert got == ["c", "b", "d"]


def test_fmt_date_local_date_no_zone_shift(spark):
    cases = {
        "2024-01-05T23:30:00-04:00": "2024-01-05",
        "2024-01-05T23:30:00-0400": "2024-01-05",
        " 2024-01-05T01:02:03Z ": "2024-01-05",
        "20240105": "2024-01-05",
        "20240105T101010": "2024-01-05",
        "20241399": None,
        "1711123012345": None,
        "Posted 3 Days Ago": None,
        "": None,
        None: None,
    }
    for raw, want in cases.items():
        assert one(spark, V.fmt_date(F.col("v")), raw) == want, raw


def test_html_to_text_rules(spark):
    html = ("<html><style>p{x}</style><script>var a='<b>';</script><p>Caf&eacute; &amp; "
            "&lt;b&gt;bold&lt;/b&gt;</p>\n\t<div>x y</div></html>")
    # script/style dropped, entities decoded once, encoded tags stripped too, all
    # whitespace (NBSP included) collapsed
    assert one(spark, T.html_to_text(F.col("v"), full_unescape=True), html) == "Café & bold x y"
    assert one(spark, T.html_to_text(F.col("v"), max_len=4), "<p>abcdef</p>") == "abcd"
    assert one(spark, T.html_to_text(F.col("v")), None) == ""
    # '&amp;lt;' decodes once to '&lt;' (not to '<')
    assert one(spark, T.html_to_text(F.col("v")), "a &amp;lt; b") == "a &lt; b"


def test_extract_emails_filters(spark):
    html = ('<a href="MAILTO:Jane.Doe@Corp.NL?subject=x">m</a> info@corp.nl hr-team@corp.nl '
            'infodesk@corp.nl ab@corp.nl x@test.corp.nl bob@example.org joe@nodot')
    got = sorted(one(spark, T.extract_emails(F.col("v")), html))
    assert got == ["infodesk@corp.nl", "jane.doe@corp.nl"]
    assert one(spark, T.first_email(F.col("v")), html) == "infodesk@corp.nl"


def test_keyword_predicates_are_substrings(spark):
    assert one(spark, P.is_location(F.col("v")), "Leiden, NL") is True
    assert one(spark, P.is_location(F.col("v")), None) is False
    assert one(spark, P.is_target_role(F.col("v")), "Lead iOS Developer") is True
    assert one(spark, P.is_target_role(F.col("v")), "Leadership Coach") is False
    assert one(spark, P.is_target_role(F.col("v")), "Staff Accountant") is False
    assert one(spark, P.title_regex(F.col("v")), "Senior AI-Engineer") is True
    assert one(spark, P.title_regex(F.col("v")), "Email marketing") is False


def test_rule_score_hand_cases(spark):
    df = spark.createDataFrame([
        ("Senior Software Engineer", "Java, Kafka, AWS", None, None),      # 30 + 3*5 (java ... ai? no)
        ("Staff Engineer", "Dutch speaking required", False, False),        # 0 - 20 - 20 - 10 - 30 → 0
        ("Data Analyst", "", None, None),
    ], "job_title string, description string, visa_support boolean, relocation_support boolean")
    got = [r[0] for r in df.select(S.rule_score(notes=F.lit(None).cast("string"),
                                                company=F.lit("Co").cast("string"))).collect()]
    # title text 'senior software engineer co': role 30; skills in text: java, kafka, aws,
    # software engineer → 4 x 3 = 12
    assert got == [42, 0, 0]


def test_parse_reply(spark):
    cases = {
        '```json\n{"score": 85, "reason": "x"}\n```': 85,
        '{"score": 120}': 99,
        '{"score": -3}': 0,
        "no json here": None,
        '{"reason": "missing"}': None,
    }
    for reply, want in cases.items():
        assert one(spark, S.parse_reply(F.col("v")), reply) == want, reply


def test_url_helpers(spark):
    df = spark.createDataFrame([("/jobs/12", "https://a.example.org:8080/careers?x=1")], "u string, b string")
    assert df.select(V.resolve_url("u", "b")).first()[0] == "https://a.example.org:8080/jobs/12"
    assert one(spark, V.canonical_url(F.col("v")), "https://x/jobs/42?y") == "https://jobs.booking.com/booking/jobs/42"
    assert one(spark, V.canonical_url(F.col("v")), "") is None
    assert one(spark, V.slugify(F.col("v")), "  Senior C++ / Go Dev!") == "senior-c-go-dev"
    assert one(spark, V.quote_param(F.col("v")), "Den Haag/NL*~") == "Den%20Haag/NL%2A~"
    assert one(spark, V.join_place(F.col("v"), F.lit("")), "Amsterdam") == "Amsterdam"


def test_fmt_date_iso_week_dates(spark):
    cases = {
        "2024-W01-1": "2024-01-01", "2024W011": "2024-01-01", "2024-W01": "2024-01-01", "2024W01": "2024-01-01",
        "2024-W01-1T10:00": "2024-01-01", "2020-W53-1": "2020-12-28", "2020W537": "2021-01-03",
        "2026-W01-1": "2025-12-29", "2027-W52-7": "2028-01-02",
        "2024-W53-1": None, "2024-W00-1": None, "2024-W01-8": None, "2024-W011": None, "2024W01-1": None,
    }
    for raw, want in cases.items():
        assert one(spark, V.fmt_date(F.col("v")), raw) == want, raw


def test_every_reference_is_decoded_natively(spark):
    import html

    texts = ["Caf&eacute; &#8217;x&#8217; M&uuml;nchen", "&#34;a&#x22; &amp;lt; &amp;#34;", "R&D & &unknown; &;", "&#128; &#x9f;",
             "&#0; &#xD800; &#1114112; &#x1F600; &NotEqualTilde;", "&", "&&amp;&", "", "no reference", "&#7;x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.u for r in df.select("i", T.unescape(F.col("t")).alias("u")).orderBy("i").collect()]
    assert got == [html.unescape(t) for t in texts]


def test_scores_beyond_32_bits_clamp(spark):
    df = spark.createDataFrame([('{"score": 99999999999}',), ('{"score": -99999999999}',), ('{"score": 50}',),
                                ('{"score": "x"}',)], "r string")
    assert [r.s for r in df.select(S.parse_reply(F.col("r")).alias("s")).collect()] == [99, 0, 50, None]


def test_references_are_read_as_the_standard_library_does(spark):
    import html
    import html.entities
    import random

    from postwise.functions.text import unescape_native

    rng = random.Random(4)
    names = list(html.entities.html5)
    texts = [f"x &{n}y &{n.rstrip(';')} &{n.rstrip(';')}1; &{n[:-2]}" for n in names]
    parts = ["&", ";", "#", "x", "amp", "not", "in", "lt", "38", "x26", "&#", "&#x", " ", "<", "copy", "&copy", "frac12", "AElig", "0", "é"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)]
    texts += [f"&#{i} &#{i};" for i in (*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.u for r in df.select("i", unescape_native(F.col("t")).alias("u")).collect()}
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if got[i] != html.unescape(t)]
    assert not wrong, wrong[:5]

"""Scalar values, as one-row tables."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from jobtide.functions import changes, dates, jsonx, location, salary, scores, text
from jobtide.operators import sinks
from jobtide.sources.company_csv import field_of_header


def test_title_white_space_is_unicode(evaluate):
    got = evaluate("string", ["  Senior \tData  Engineer\n", "", None], text.normalize_title)
    assert got == ["senior data engineer", "", None]


def test_ingest_title_keeps_inner_space(evaluate):
    assert evaluate("string", ["  Data  Engineer "], text.ingest_title) == ["data  engineer"]


def test_dedup_key(evaluate):
    got = evaluate("string", [" Data  Engineer"], lambda c: text.dedup_key(c, F.lit(" Tech Corp ")))
    assert got == ["data engineer|tech corp"]
    assert evaluate("string", ["A"], lambda c: text.dedup_key(c, F.lit(None).cast("string"))) == ["a|"]


def test_html_to_text(evaluate):
    html = [
        "<div><p>This is a <strong>job</strong> description.</p></div>", "a &amp; b &lt;c&gt; &quot;d&quot; &#39;e&#39;&nbsp;f",
        "&amp;lt;b&amp;gt;", "<p>  </p>", "", None,
    ]
    assert evaluate("string", html, text.html_to_text) == [
        "This is a job description.", "a & b <c> \"d\" 'e' f", "<b>", None, None, None,
    ]


def test_ensure_url(evaluate):
    urls = ["example.com", "http://a.b", " https://c.d ", "", "  ", None, "ftp://x"]
    assert evaluate("string", urls, text.ensure_url) == [
        "https://example.com", "http://a.b", "https://c.d", None, None, None, "https://ftp://x",
    ]


def test_split_list(evaluate):
    assert evaluate("string", ["IT,  Software , ,Banking", "", None], text.split_list) == [["IT", "Software", "Banking"], [], []]
    assert evaluate("string", ["IT, ,x"], lambda c: text.split_list(c, keep_blanks=True)) == [["IT", "", "x"]]


def test_company_columns(evaluate):
    got = evaluate("string", [" Tech Corp "], lambda c: text.company_columns(c, F.lit(" 12 "), F.lit("a.com"), F.lit("logo"), F.lit("  ")))
    assert got == [{"name": "Tech Corp", "linkedin_company_id": "12", "company_url": "https://a.com", "logo_url": None, "industry": None}]


@pytest.mark.parametrize(
    ("value", "city", "region", "country"),
    [
        ("Belgium", "Belgium", None, None),
        ("nl", None, None, "NL"),
        ("New York, NY", "New York", "NY", None),
        ("Gent, Belgium", "Gent", None, None),
        ("Amsterdam, North Holland, NL", "Amsterdam", "North Holland", "NL"),
        ("London, England, United Kingdom", "London", "England", None),
        ("Sydney, nsw", "Sydney", "NSW", None),
    ],
)
def test_location(evaluate, value, city, region, country):
    got = evaluate("string", [value], location.location_columns)[0]
    assert (got["city"], got["region"], got["country_code"]) == (city, region, country)


def test_record_location(evaluate):
    got = evaluate("string", ["Belgium", "BE", "Miami, FL", "Gent, Belgium", "A, B, CC"], location.record_location_columns)
    assert [(g["city"], g["region"], g["country_code"]) for g in got] == [
        (None, None, None), (None, None, "BE"), ("Miami", "FL", "FL"), ("Gent", None, None), ("A", "B", "CC"),
    ]


def test_search_location(evaluate):
    got = evaluate("string", ["Gent", " brussel ", "Leuven", "Gent, BE", "Paris", "luik"], location.search_location_columns)
    assert [(g["search_location"], g["country_code"]) for g in got] == [
        ("Ghent, Belgium", "BE"), ("Brussels, Belgium", "BE"), ("Leuven, Belgium", "BE"), ("Gent, BE", ""), ("Paris", ""), ("luik, Belgium", "BE"),
    ]


def test_pay_range(evaluate):
    values = [
        "$120,000.00/yr - $150,000.00/yr", "$15.50/hr - $18.00/hr", "€50,000/yr - €70,000/yr", "invalid", None, "1 - 2 - 3", "100 - 200", "a-b",
    ]
    got = [tuple(g.values()) for g in evaluate("string", values, salary.pay_range_columns)]
    none = (None, None, None, None)
    assert got == [
        ("$", 120000.0, 150000.0, "yr"), ("$", 15.5, 18.0, "hr"), ("€", 50000.0, 70000.0, "yr"), none, none, none,
        (None, 100.0, 200.0, None), none,
    ]


def test_formatted_salary(evaluate):
    values = ["$50,000 - $70,000 a year", "€50k-€70k", "$25 - $35 an hour", "Up to $50k", "negotiable", None, "3000 per month", "£400 a week"]
    got = [tuple(g.values()) for g in evaluate("string", values, salary.formatted_salary_columns)]
    none = (None, None, None, None)
    assert got == [
        ("USD", 50000.0, 70000.0, "yearly"), ("EUR", 50000.0, 70000.0, None), ("USD", 25.0, 35.0, "hourly"), ("USD", 50000.0, 50000.0, None),
        none, none, ("USD", 3000.0, 3000.0, "monthly"), ("GBP", 400.0, 400.0, "weekly"),
    ]


def test_logo_file_name(evaluate):
    assert evaluate("string", ["Python", "Apache Spark", "C++", "C#", "scikit.learn", " a -- b "], text.logo_file_name) == [
        "python-logo.png", "apache-spark-logo.png", "cpp-logo.png", "csharp-logo.png", "scikitlearn-logo.png", "a-b-logo.png",
    ]


def test_array_literals(evaluate):
    assert evaluate("string", ['{"a","b c"}', "{a, b}", "{}", None, ""], text.parse_array_literal) == [["a", "b c"], ["a", "b"], [], [], []]
    assert evaluate("array<string>", [["a", 'q"x'], [], None], text.format_array_literal) == ['{"a","q\\"x"}', "{}", "{}"]


def test_spreadsheet_cells(evaluate):
    assert evaluate("string", [" 48256.0 ", "12", " ", None], text.spreadsheet_id) == ["48256", "12", None, None]
    assert evaluate("string", ["c. 1999", "x", None], text.digits_as_int) == [1999, None, None]


def test_headers():
    headers = ["LinkedIn Company ID", "Company Name", "Company Number (KBO/VAT)", "Industry", "Founded Year", "Jobs Page URL", "Contact Email", "Website"]
    assert [field_of_header(h) for h in headers] == [
        "linkedin_company_id", "company_name", None, "industry", "founded_year", "jobs_page_url", "contact_email", "website",
    ]


def test_lenient_timestamp(evaluate):
    got = evaluate("string", ["2025-10-01T12:00:00+05:00", "2025-10-01T12:00:00Z", "2025-10-02", "soon", None], dates.lenient_timestamp)
    assert got == [dt.datetime(2025, 10, 1, 12), dt.datetime(2025, 10, 1, 12), dt.datetime(2025, 10, 2), None, None]


def test_lookback(evaluate):
    assert evaluate("int", [0, 1, 3, 7, 30, 60], dates.lookback_window) == ["past_24h", "past_24h", "past_week", "past_week", "past_month", "past_month"]
    assert evaluate("int", [None, 0, 5, 30, 90], dates.incremental_days) == [30, 1, 7, 30, 30]


@pytest.mark.parametrize(
    ("message", "hours_ago", "retry"),
    [
        (None, 48, False), ("", 48, False), ("quota", None, True), ("quota exceeded", 23, False), ("Error 429", 24, True),
        ("Too Many Requests", 30, True), ("read timed out", 30, True), ("could not parse JSON", 300, False), ("validation failed", 30, False),
        ("something else", 30, True), ("quota reached while parsing json", 30, True),
    ],
)
def test_should_retry(evaluate, message, hours_ago, retry):
    now = "2025-01-10 00:00:00"
    last = None if hours_ago is None else dt.datetime(2025, 1, 10) - dt.timedelta(hours=hours_ago)
    got = evaluate("timestamp", [last], lambda c: dates.should_retry(F.lit(message).cast("string"), c, now))
    assert got == [retry]


def test_freshness(evaluate):
    now = dt.datetime(2025, 1, 31)
    ages = [29, 30, 31, 48, 144, 240, 480, 960]
    posted = [now - dt.timedelta(hours=h) for h in ages] + [None, now + dt.timedelta(hours=5)]
    assert evaluate("timestamp", posted, lambda c: scores.freshness(c, now)) == [150, 150, 90, 90, 75, 60, 40, 20, 20, 150]


def test_role_match(evaluate):
    roles = [None, "", "Other", "NIS", "Data Scientist", "Analytics Engineer", "BI Developer", "Data Architect"]
    assert evaluate("string", roles, scores.role_match) == [10, 10, -200, -99999, 100, 90, 85, 70]


def test_hourly_multiplier(evaluate):
    now = "2025-01-31 14:59:00"
    ids = ["a1", "b2", "c3"]
    expected = []
    for i in ids:
        n = int(hashlib.md5(f"2025-01-31-14-{i}".encode()).hexdigest()[:8], 16)
        expected.append(0.8 + n % 10000 / 10000 * 0.4)
    assert evaluate("string", ids, lambda c: scores.hourly_multiplier(c, now)) == expected


def test_label_value(evaluate):
    labels = [
        '{"nl":{"seniority":["Junior","Senior"]},"en":{"seniority":"x"}}', '{"nl":{"seniority":[]},"en":{"seniority":"Senior"}}',
        '{"fr":{"seniority":["Expert"]}}', "{}", None, "not json", '{"nl":{"seniority":""}}',
    ]
    assert evaluate("string", labels, lambda c: jsonx.label_value(c, "seniority")) == ["Junior", "Senior", "Expert", None, None, None, None]


def test_perks(evaluate):
    perks = ['[{"key":"car","found":true,"value":"yes"}]', '[{"key":"car","found":false}]', "[]", None]
    assert evaluate("string", perks, lambda c: jsonx.has_entry(c, "car")) == [True, False, False, False]
    assert evaluate("string", perks, lambda c: jsonx.entry_value(c, "car")) == ["yes", None, None, None]


def test_merge_text_map(evaluate):
    got = evaluate("string", ['{"a":"1","b":"2"}', None], lambda c: jsonx.merge_text_map(c, F.lit('{"b":"3"}')))
    assert got == ['{"a":"1","b":"3"}', '{"b":"3"}']


def test_changes(spark):
    old = {"title": "A", "num_applicants": 1, "base_salary_min": None, "base_salary_max": 2.0, "employment_type": "F", "seniority_level": "S", "application_available": True}
    cases = [({}, []), ({"num_applicants": 2}, ["num_applicants"]), ({"base_salary_min": 1.0}, ["base_salary_min"]), ({"seniority_level": None, "title": "B"}, ["title", "seniority_level"])]
    ddl = "struct<title:string,num_applicants:int,base_salary_min:double,base_salary_max:double,employment_type:string,seniority_level:string,application_available:boolean>"
    df = spark.createDataFrame([(i, old, {**old, **c}) for i, (c, _) in enumerate(cases)], f"i int, old {ddl}, new {ddl}")
    rows = df.select("i", changes.changed_fields("old", "new", changes.WATCHED).alias("f"), changes.any_changed("old", "new").alias("any")).orderBy("i").collect()
    assert [list(r["f"]) for r in rows] == [f for _, f in cases]
    assert [r["any"] for r in rows] == [bool(f) for _, f in cases]


def test_classifier_answers(evaluate):
    got = evaluate("string", ["Data", " NIS ", "data", ""], sinks.title_class_columns)
    assert [tuple(g.values()) for g in got] == [
        ("Data", None), ("NIS", None), (None, "Unexpected classification: data"), (None, "Unexpected classification: "),
    ]
    got = evaluate("string", ["85", " 0 ", "101", "high", "7.5"], sinks.relevance_columns)
    assert [g["relevance_score"] for g in got] == [85, 0, None, None, None]
    assert got[2]["relevance_error"] == "Score out of range: 101" and got[3]["relevance_error"] == "Invalid score format: high"

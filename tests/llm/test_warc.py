import pytest
from pyspark.sql import functions as F

from quillstream.llm import warc
from quillstream.llm.queries import oracle_sql, queries


def test_query_equals_its_sql(same):
    same(queries()["op8_warc_revisits"], oracle_sql()["op8_warc_revisits"])


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.Example.com:80/a/b/?b=2&a=1&utm_source=x#top", "example.com/a/b?a=1&b=2"),
        ("https://example.com", "example.com"),
        ("https://example.com/?", "example.com"),
        ("example.com/x?y=/z/", "example.com/x?y=/z/"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_urls(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == key


RECORD = "record_id long, warc_type string, url string, ts long, etag string, last_modified string, headers map<string,string>, near string"


def resolve(spark, rows):
    return {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame([(*r, "x") for r in rows], RECORD)).collect()}


def test_outcomes_and_headers(spark):
    u = "http://e.com/"
    rows = [
        (1, "response", u, 100, '"a"', "m1", {"date": "1", "content-type": "t", "etag": '"a"'}),
        (2, "response", u, 200, None, "m2", None),
        (3, "revisit", u, 150, 'W/"a"', "other", {"date": "2", "content-type": "no", "vary": "v"}),
        (4, "revisit", u, 150, '"b"', "m1", None),
        (5, "revisit", u, 250, '"a"', "m2", {"expires": "e"}),
        (6, "revisit", u, 250, '"a"', None, None),
        (7, "revisit", u, 100, '"a"', None, None),
        (8, "revisit", None, 300, '"a"', None, None),
        (9, "revisit", "http://other.com", 300, None, None, None),
        (11, "revisit", u, None, '"a"', None, None),
        (12, "response", u, None, '"z"', None, None),
        (10, "revisit", u, 200, '"a"', None, None),
        (10, "revisit", u, 200, '"a"', None, None),
    ]
    found = resolve(spark, rows)
    assert {k: (r.outcome, r.response_id) for k, r in found.items()} == {3: ("resolved", 1), 4: ("mismatch", 1), 5: ("resolved", 2), 6: ("unvalidated", 2), 7: ("no_prior", None), 8: ("no_url", None), 9: ("no_prior", None), 11: ("no_prior", None), 10: ("resolved", 1)}
    assert found[3].headers == {"date": "2", "content-type": "t", "etag": '"a"', "vary": "v"} and found[5].headers == {"expires": "e"} and found[4].headers is None
    assert resolve(spark, []) == {}


def test_one_url_over_many_ranges(spark):
    """Half of all records are of one URL; each finds the response just before it."""
    rows = [(i, "response" if i % 7 == 0 else "revisit", "u" if i % 2 else f"v{i}", i, None, None, None) for i in range(1, 4000)]
    found = resolve(spark, rows)
    last = {}
    for i, kind, url, *_ in rows:
        if kind == "response":
            last[url] = i
        else:
            assert found[i].response_id == last.get(url)

import re

from hypothesis import given, settings, strategies as st

from parley.llm import urls

from .helpers import rows


def as_regex(glob):
    out = ""
    i = 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "."}.get(glob[i], re.escape(glob[i])), i + 1
    return re.compile(out, re.S)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab/.*?", max_size=9), min_size=1, max_size=30), st.lists(st.text("ab/.é", max_size=12), max_size=8))
def test_globs_against_regex(globs, texts):
    auto = urls.compile_globs(globs)
    got = urls.matches(auto, texts)
    for i, t in enumerate(texts):
        assert [bool(as_regex(g).fullmatch(t)) for g in globs] == got[i].tolist()


def test_many_words_of_masks():
    globs = [f"*.site{i}.org/p{i}/**" for i in range(300)]
    auto = urls.compile_globs(globs)
    assert auto.mask.shape[1] > 60
    hit = urls.matches(auto, [".www.site7.org/p7/x", ".site299.org/p299/", ".site3.org/p4/"])
    assert hit[0].nonzero()[0].tolist() == [7] and hit[1].nonzero()[0].tolist() == [299] and not hit[2].any()


def plain_rule(host, path):
    best = None
    for r in urls.SITE_RULES:
        h, p = r.name.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.name) > len(best.name)):
            best = r
    return best


def test_site_rules(spark):
    given_urls = ["http://A.Example.ORG/en/1x?y", "https://example.org/es/", "ftp://org", "http://notorg/", "http://x.com/fr/a#b", "http://com/de/", "nothing", None, "",
                  "http://evil.com/x.org/", "://org/", "a://b://org/", "http://example.org/en/2", "http://h.net/login/now", "http://org?x/", "http://com/fr"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(given_urls)] + [(None, None, "x")], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in rows(urls.filter_urls(df.union(df.where("page_id = 0"))))}
    assert urls.filter_urls(df.union(df.where("page_id = 0"))).count() == len(given_urls) + 2
    for i, u in enumerate(given_urls):
        if not u or "://" not in u:
            host = path = ""
        else:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host):])[0]
            host = host.lower()
        want = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, want.name if want else None), u
        if want:
            assert got[i]["verdict"] == want.verdict
    assert got[13]["verdict"] == "block" and got[13]["rule"] is None and got[7]["verdict"] == "allow"
    assert rows(urls.filter_urls(df.limit(0))) == []

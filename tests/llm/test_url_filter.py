import fnmatch
import random
import re

from pyspark.sql import functions as F

from tallyloft.llm import url_filter as U
from tallyloft.llm.queries import URL_RULES

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    hits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(hits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def urls():
    rng = random.Random(3)
    hosts = ["net", "a.net", "example.net", "A.EXAMPLE.net", "xnet", "example.com", "b.example.com", "org", "x.org", "", "evil.com", "müll.net", "net:80"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/y", "/x.example.net/en/", "/a/net/", "/*", "/é"]
    out = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#f', '?a://b'])}" for _ in range(400)]
    return out + [None, "", "net/", "http:/net/", "http://" + "a" * 5000 + ".net/" + "b" * 70000, "x://net/\nline"]


def test_query_rules_against_plain_code(spark):
    rows = [(i, u, "mine", 1) for i, u in enumerate(urls())]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string, t int")
    got = U.filter_urls(df, URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"]), r["url"]
        assert r["t"] == 1


def test_globs_over_many_words():
    rng = random.Random(1)
    globs = ["".join(rng.choice("ab*?/.") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    texts = ["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    automaton = U.GlobAutomaton([U.Rule(f"{i:03}", (g,), "block") for i, g in enumerate(globs)])
    found = automaton.match([t.encode() for t in texts])

    def regex(g):
        return re.compile("".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in re.sub(r"\*\*+", "\0", g)).replace("\\\0", "\0").replace("\0", ".*") + r"\Z", re.S)

    compiled = [regex(g) for g in globs]
    for t, f in zip(texts, found):
        want = next((i for i, c in enumerate(compiled) if c.match(t)), -1)
        assert f == want, (t, globs[want] if want >= 0 else None, globs[f] if f >= 0 else None)
    assert automaton.words > 1
    assert fnmatch  # the globs differ from fnmatch's in that * stops at a slash


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(df, URL_RULES).count() == 0


def test_columns_of_the_results_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", "old", "old", "old", 5, "kept")], "page_id long, url string, host string, path string, rule string, verdict int, more string")
    got = U.filter_urls(df, URL_RULES)
    assert sorted(got.columns) == sorted(["page_id", "url", "more", "host", "path", "rule", "verdict"])
    r = got.first()
    assert (r["host"], r["path"], r["rule"], r["verdict"], r["more"]) == ("a.net", "/x", "net/", "block", "kept")
    renamed = df.select("page_id", F.col("url").alias("host"), F.lit("z").alias("rule"))
    r = U.filter_urls(renamed, URL_RULES, url="host").first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == ("a.net", "/x", "net/", "block")

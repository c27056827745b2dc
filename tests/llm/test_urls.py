from slicer.llm import urls
from slicer.llm.queries import URL_RULES


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
        rest = rest[k:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for verdict, rule in URL_RULES:
        name, _, below = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + below) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_rules(spark):
    given = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://a.example.org/en/2", "http://org/", "http://org", "http://myorg/", "http://x.com/fr/", "http://x.com/de/a", "http://x.com/en/a", "http://x.net?u=http://y.com/de/", "http://É.COM/fr/ß", "a://b://c", "http://h#f/q", "http://com/de/\nz"]
    df = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(given)] + [(3, given[3], None, "clash")], "page_id bigint, url string, html string, host string")
    got = urls.verdicts(df, URL_RULES).collect()
    assert len(got) == len(given) + 1
    for r in got:
        host, path, best = brute(given[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[1], best[0] if best else "allow")
    assert urls.verdicts(df.limit(0), URL_RULES).collect() == []


def test_distrust_runs_against_links(spark):
    rows = [
        (1, "http://bad.com/de/1", ""),
        (2, "http://linker.net/1", '<a href="http://BAD.com/x">b</a> <a href=//bad.com/y>c</a>'),
        (3, "http://far.net/1", "<a href='https://linker.net/'>l</a>"),
        (4, "http://good.org/1", '<a href="http://fine.net/a">f</a>'),
        (5, "http://fine.net/2", None),
        (6, "http://alone.net/", "<a href='/local'>x</a>"),
    ]
    got = {r.page_id: r for r in urls.verdicts(spark.createDataFrame(rows, "page_id bigint, url string, html string"), URL_RULES).collect()}
    assert [got[i].verdict for i in range(1, 7)] == ["block", "block", "block", "allow", "allow", "allow"]
    # against ranks computed by hand: 0.15 at the seed, then 0.85 a step
    assert abs(got[2].distrust - 0.15 * 0.85) < 1e-9 and abs(got[3].distrust - 0.15 * 0.85**2) < 1e-9 and abs(got[5].trust - 0.15 * 0.85) < 1e-9


def linked_pages():
    """A chain of 24 linkers to a blocked host, a cycle, a mixed host, a host between good and bad, repeated rows."""
    link = lambda *to: " ".join(f'<a href="http://{t}/x">l</a>' for t in to)
    rows = [("http://bad.com/de/1", "")] + [(f"http://c{i}.net/", link("bad.com" if i == 1 else f"c{i - 1}.net")) for i in range(1, 25)]
    rows += [(f"http://ring{i}.net/", link(f"ring{(i + 1) % 5}.net", *(["bad.com"] if i == 2 else []))) for i in range(5)]
    rows += [("http://mixed.com/de/1", None), ("http://mixed.com/de/2", None), ("http://mixed.com/fr/1", None), ("http://mixed.com/en/1", None), ("http://to-mixed.net/", link("mixed.com"))]
    rows += [("http://good.org/1", link("fine.net", "both.net"))] * 3 + [("http://both.net/", link("bad.com")), ("http://fine.net/", link("good.org", "FINE.net"))]
    rows += [("http://even.com/de/1", ""), ("http://even.com/fr/1", ""), ("http://even.com/en/1", ""), ("http://to-even.net/", link("even.com")), (None, link("bad.com")), ("", None)]
    return [(i, *r) for i, r in enumerate(rows)]


def brute_ranks(rows):
    """Trust and distrust of every host by 400 plain rounds."""
    import collections
    import re

    net, edges = collections.Counter(), collections.Counter()
    for _, url, html in rows:
        host, _, best = brute(url)
        if best:
            net[host] += 1 if best[0] == "allow" else -1
        for to in re.findall(r'href="http://([^/]*)', html or ""):
            if host and to.lower() != host:
                edges[host, to.lower()] += 1
    out = []
    for sign, pairs in ((1, edges), (-1, {(b, a): n for (a, b), n in edges.items()})):
        seed = {h: max(0, sign * n) * 0.15 for h, n in net.items()}
        total = collections.Counter()
        for (a, _), n in pairs.items():
            total[a] += n
        rank = dict(seed)
        for _ in range(400):
            after = collections.Counter(seed)
            for (a, b), n in pairs.items():
                after[b] += 0.85 * rank.get(a, 0) * n / total[a]
            rank = after
        out.append(rank)
    return out


def test_ranks_of_chains_and_cycles(spark, tmp_path):
    import duckdb

    from slicer.llm import oracles

    rows = linked_pages()
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in urls.verdicts(df, URL_RULES).collect()}
    trust, distrust = brute_ranks(rows)
    for i, url, _ in rows:
        host, _, best = brute(url)
        t, d = trust.get(host, 0), distrust.get(host, 0)
        assert abs(got[i].trust - t) <= 0.01 * (t + 1e-3) and abs(got[i].distrust - d) <= 0.01 * (d + 1e-3)
        assert got[i].verdict == (best[0] if best else "block" if d - t > 1e-3 else "allow"), url
    by_host = {r.host: r.verdict for r in got.values() if r.rule is None}
    assert all(by_host[f"c{i}.net"] == "block" for i in range(1, 25)) and all(by_host[f"ring{i}.net"] == "block" for i in range(5))
    assert by_host["mixed.com"] == by_host["to-mixed.net"] == "block" and by_host["even.com"] == by_host["to-even.net"] == by_host["fine.net"] == by_host["both.net"] == "allow"
    df.write.parquet(f"{tmp_path}/pages.parquet")
    sql = duckdb.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'; {oracles.urls(URL_RULES)}").fetchall()
    assert sorted((p, v) for p, *_, v in sql) == sorted((r.page_id, r.verdict) for r in got.values())
